"""The command line on a small rule file and state."""

from quillgraph.__main__ import main
from quillgraph.dsl import parse
from quillgraph.functions import identity
from quillgraph.sources import write_json_state
from quillgraph.state import empty_state

RULES = """
schema { entity a { n: int64; m: int64 optional; at: timestamp optional; } }
rule one { select a group_by a.n set a.m = a.n * 2; }
checkpoint c after one;
profile p for entity a { require a.m present as M; }
"""


def test_commands(spark, tmp_path, capsys):
    lineage = identity.lineage_id("tests", "cli")
    schema = parse(RULES).schema
    rows = [(identity.source_id(lineage, "a", str(i)), i, None, 10**9 * i + 5) for i in range(3)]
    state = empty_state(spark, schema, lineage).with_kind("a", spark.createDataFrame(rows, schema.entity("a").struct()))
    rules, before, after = (str(tmp_path / n) for n in ("r.rules", "before.json", "after.json"))
    (tmp_path / "r.rules").write_text(RULES)
    write_json_state(state, before)
    assert main(["compile", rules]) == 0 and main(["format", rules]) == 0
    assert main(["run", rules, before, after]) == 0
    assert "accepted" in capsys.readouterr().out
    assert main(["diff", before, after]) == 0
    assert capsys.readouterr().out.count("modified a") == 3
    assert main(["sql", rules, "a", lineage]) == 0 and main(["project", rules, str(tmp_path / "project"), lineage]) == 0
    assert (tmp_path / "project" / "dbt_project.yml").exists()
    assert main(["gate", rules, rules, "p", "c", before]) == 0
    assert "authorised" in capsys.readouterr().out
    assert main([]) == 2
    (tmp_path / "bad.rules").write_text(RULES.replace("a.n * 2", "a.x"))
    try:
        main(["compile", str(tmp_path / "bad.rules")])
        raise AssertionError
    except SystemExit as e:
        assert e.code == 1
