"""Documents to encoded training text: the stages of weir.llm.pipeline, where their code is."""

from weir.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
