"""Table profiling and feature preparation as Spark DataFrame jobs."""

from gristmill.session import build_session, ensure_checkpoint_dir, scratch_path

__all__ = ["build_session", "ensure_checkpoint_dir", "scratch_path"]
