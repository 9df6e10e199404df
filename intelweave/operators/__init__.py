"""DataFrame -> DataFrame operators.

Grouping columns are passed as ``by`` (default: one actor per group); merge
order as ``order`` (default: source rank, then position inside the source).
"""

from __future__ import annotations

BY = ("actor",)
ORDER = ("source_rank", "pos")
