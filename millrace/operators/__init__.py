"""Row, split, metric, feature and model operators."""
