"""fieldchirp: acoustic-monitoring analytics expressed as Spark plans.

The spine of the library is the key ``(file, start_time, end_time)``: clips,
labels, scores, embeddings and detections are DataFrames on it.
"""

__version__ = "0.1.0"
