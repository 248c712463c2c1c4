"""Vectors packed into blocks, and a query set against all blocks: those of the library."""

from __future__ import annotations

from docloom.operators.blocks import pack, search, top_of_block, unpack

__all__ = ["pack", "search", "top_of_block", "unpack"]
