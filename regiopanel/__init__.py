"""regiopanel: region x month panel analytics on Spark DataFrames.

A *store* is a plain ``dict`` of DataFrames keyed by table name (see
``regiopanel.schemas.TABLES``).  Every operator takes DataFrames (or a store)
and returns DataFrames; nothing is collected to the driver except scalar
parameters.
"""

from regiopanel.session import get_session, ensure_checkpoint_dir

__all__ = ["get_session", "ensure_checkpoint_dir"]
