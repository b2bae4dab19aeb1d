"""factloom: profiling, facts and ranked evidence for flat tables, on Spark DataFrames."""

from factloom.plans.pipeline import build_knowledge
from factloom.plans.workspace import Workspace
from factloom.sources.store import CommitConflict, DatasetNotFound, DatasetNotReady, KnowledgeStore, Snapshot

__all__ = [
    "CommitConflict",
    "DatasetNotFound",
    "DatasetNotReady",
    "KnowledgeStore",
    "Snapshot",
    "Workspace",
    "build_knowledge",
]
