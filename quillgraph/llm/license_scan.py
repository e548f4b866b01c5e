"""Licence scans by sentence rules.

A text is cut into sentences at blank lines and at ``.``, ``;``, ``!``, ``?`` or ``:`` before white space (but not in
"v. 2.0"); line breaks within a sentence count as spaces, so wrapped texts are read. Each sentence is normalised (A-Z
lower-cased, all but letters, digits, ``.`` and ``-`` turned into one space, trimmed, final dots dropped), and known licence
sentences are mapped to identifiers. Where a sentence of several lines is unknown, each of its lines is looked up by itself: a notice
may stand on a line between lines without punctuation. Then the sequence of identifiers of a document is matched against
ordered rules: a rule is a run of identifiers; at each place the longest rule wins and
takes its identifiers, as the next place starts behind it.

All of it is one pass of DataFrame functions without a shuffle: the sentences are a
fixed vocabulary (``SENTENCES``), bounded by its own text and so kept in the plan.

Edge cases: a null or empty text has no licence (empty arrays); a repeated sentence
gives its identifier again; rows are judged one by one, repeated ids included;
columns other than the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_az

#: Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "apache-2.0-notice",
    "licensed under the apache license version 2.0 the license": "apache-2.0-header",
    "you may not use this file except in compliance with the license": "apache-2.0-compliance",
    "you may obtain a copy of the license at": "apache-2.0-copy",
    "see the license for the specific language governing permissions and limitations under the license": "apache-2.0-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied": "as-is-software",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is-software",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0-notice",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0-notice",
    "this program is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-3.0-or-later-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-2.0-or-later-terms",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0-notice",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0-notice",
    "licensed under cc by 4.0": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution 4.0 international license": "cc-by-4.0-notice",
    "this work is licensed under a creative commons attribution-noncommercial 4.0 international license": "cc-by-nc-4.0-notice",
    "this work is licensed under a creative commons attribution-sharealike 4.0 international license": "cc-by-sa-4.0-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl-2.0-notice",
    "all rights reserved": "all-rights-reserved",
}

#: Ordered rules, each a run of identifiers.
RULES = [
    ("Apache-2.0", ["apache-2.0-header", "apache-2.0-compliance", "apache-2.0-copy", "apache-2.0-see"]),
    ("Apache-2.0", ["apache-2.0-header", "apache-2.0-compliance", "apache-2.0-copy"]),
    ("Apache-2.0", ["apache-2.0-header", "apache-2.0-compliance"]),
    ("Apache-2.0", ["apache-2.0-notice", "apache-2.0-compliance", "apache-2.0-copy"]),
    ("Apache-2.0", ["apache-2.0-notice"]),
    ("MIT", ["mit-notice", "mit-grant", "mit-condition", "as-is-software"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is-software"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3.0-or-later-terms", "gpl-copy"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-3.0-or-later-terms"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2.0-or-later-terms", "gpl-copy"]),
    ("GPL-2.0-or-later", ["gpl-free", "gpl-2.0-or-later-terms"]),
    ("GPL-3.0", ["gpl-3.0-notice"]),
    ("GPL-2.0", ["gpl-2.0-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4.0-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4.0-notice"]),
    ("CC-BY-4.0", ["cc-by-4.0-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("MPL-2.0", ["mpl-2.0-notice"]),
    ("Proprietary", ["all-rights-reserved"]),
]

#: A sentence that maps to an identifier has one of these stems; other sentences are not looked up.
STEM = r"licen[sc]|permi|redistribut|free software|copy of the gnu|software is provided|above copyright|rights reserved"
CUT = r"\r?\n[ \t]*(?:\r?\n[ \t]*)+|(?<!(?:^|[^\p{L}\p{N}])[vV])[.;!?:](?=\s|$)"
LINES = r"[\r\n]+"
NOT_WORD = r"[^\p{L}\p{N}.-]+"


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """The identifiers of a text's known sentences, in text order; own ``sentences`` need none of the stems."""
    known = SENTENCES if sentences is None else sentences
    table = F.create_map(*[F.lit(x) for pair in sorted(known.items()) for x in pair])
    stem = (lambda s: lower_az(s).rlike(STEM)) if sentences is None else (lambda s: F.lit(True))
    look = lambda s: F.try_element_at(table, F.regexp_replace(F.trim(F.regexp_replace(lower_az(s), NOT_WORD, " ")), r"\.+$", ""))
    there = lambda ids: F.filter(ids, lambda i: i.isNotNull())
    lines = lambda s: F.transform(F.filter(F.split(s, LINES), stem), look)
    whole = F.transform(F.filter(F.split(text, CUT), stem), lambda s: F.transform(F.array(look(s)), lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(there(lines(s))))[0])
    return F.when(text.isNotNull() & stem(text), F.flatten(whole)).otherwise(F.array().cast("array<string>"))


def match_rules(ids: Column, rules: list[tuple[str, list[str]]] | None = None) -> Column:
    """The licences of the rules that match, in order: leftmost, longest, without overlap."""
    known = RULES if rules is None else rules
    runs = sorted(((len(run), name, run) for name, run in known), key=lambda x: (-x[0], x[1], x[2]))
    start = F.struct(F.array().cast("array<string>").alias("names"), F.lit(0).alias("skip"))

    def step(state: Column, i: Column) -> Column:
        best = F.lit(None).cast("struct<name:string,n:int>")
        for n, name, run in reversed(runs):  # the first of ``runs`` is the outermost test
            best = F.when(F.slice(ids, i, n) == F.array(*map(F.lit, run)), F.struct(F.lit(name).alias("name"), F.lit(n).alias("n"))).otherwise(best)
        return F.when(state["skip"] > 0, F.struct(state["names"].alias("names"), (state["skip"] - 1).alias("skip"))).otherwise(
            F.transform(F.array(best), lambda b: F.when(b.isNull(), F.struct(state["names"].alias("names"), F.lit(0).alias("skip"))).otherwise(F.struct(F.concat(state["names"], F.array(b["name"])).alias("names"), (b["n"] - 1).alias("skip"))))[0]
        )

    return F.when(F.size(ids) > 0, F.aggregate(F.sequence(F.lit(1), F.size(ids)), start, step, lambda s: s["names"])).otherwise(F.array().cast("array<string>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] | None = None, rules: list[tuple[str, list[str]]] | None = None) -> DataFrame:
    """Returns the id column, ``sentence_ids`` and ``licenses`` (arrays in text order) for every row, by own sentences and rules if given."""
    first = docs.select(F.col(id_col).alias("id"), sentence_ids(F.col(text_col), sentences).alias("sentence_ids"))
    return first.select(F.col("id").alias(id_col), "sentence_ids", match_rules(F.col("sentence_ids"), rules).alias("licenses"))
