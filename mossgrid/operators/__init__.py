"""DataFrame operators: metrics, comparison, preparation, value segmentation."""
