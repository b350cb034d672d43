"""Where tables come from and where intermediate results go."""

from .ship import ship
from .tables import bounded, durable, scratch, shared_dir, table, temporary

__all__ = ["bounded", "durable", "scratch", "shared_dir", "ship", "table", "temporary"]
