"""Writers: result tables, scorecards, reports, vocabularies, split metrics."""
