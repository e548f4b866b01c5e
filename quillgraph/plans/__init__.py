"""Plans: compilation, execution with checkpoints, completeness, diffs, corpora and the promotion gate."""
