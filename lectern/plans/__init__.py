"""End-to-end plans (evaluation and preparation jobs) built from the operators."""
