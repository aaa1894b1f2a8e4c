"""vigil — data quality, schema, metadata and run analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns a DataFrame; nothing is collected to the
driver inside an operator.  See README.md for the operator map.
"""

from vigil.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
