"""panelflow: page-level text records, from noisy detections to laid-out text, on Spark."""

__version__ = "0.1.0"
