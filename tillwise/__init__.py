"""Purchase analytics as Spark jobs: receipts in, spend, price, restock and store answers out."""

from tillwise.config import Config
from tillwise.session import local_session, settle

__all__ = ["Config", "local_session", "settle"]
__version__ = "0.1.0"
