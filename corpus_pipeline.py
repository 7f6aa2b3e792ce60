"""The training-data pipeline: documents through five operators, each stage on what its predecessor kept."""

from textlode.llm.pipeline import ORACLE_SQL, STAGES, run  # noqa: F401
