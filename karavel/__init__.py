"""Move tables from one store to another with Spark, and prove that the move is right."""

from karavel.session import build_session, shared_folder

__all__ = ["build_session", "shared_folder"]
