"""Reading raw feeds, and tables addressed by layer and name."""

from .feeds import Feed, file_ledger, key_from_path, raw_text, read_feed, read_marked, split_broken
from .lake import Lake

__all__ = ["Feed", "Lake", "file_ledger", "key_from_path", "raw_text", "read_feed", "read_marked", "split_broken"]
