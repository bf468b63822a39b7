"""weftline: a small, lazy, Spark-first dataset engine."""

from weftline.operators.dataset import Dataset
from weftline.operators.grouped import GroupedDataset
from weftline.session import Session

__all__ = ["Dataset", "GroupedDataset", "Session"]
