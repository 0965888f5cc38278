"""Small helpers that write repetitive oracle SQL (one SELECT per column)."""

from __future__ import annotations


def union_all(parts) -> str:
    return "\nUNION ALL\n".join(parts)
