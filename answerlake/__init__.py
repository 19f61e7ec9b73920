"""Answer-sheet analytics as Spark jobs: decode, rules, scoring, review, reconciliation, export."""
