"""Per-job options. A plain dataclass handed to operators; never a table."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Optional, Sequence


@dataclass(frozen=True)
class SearchOptions:
    max_pages: int = 10
    results_per_page: int = 10
    include_organic: bool = True
    include_paa: bool = False
    include_related: bool = False
    include_ads: bool = False
    include_ai_overview: bool = False
    profile_sites: Sequence[str] = field(default_factory=tuple)
    allow_duplicates: bool = False
    split_long_queries: bool = False
    country_code: Optional[str] = None
    language_code: Optional[str] = None
    apply_locale_hints: bool = False
    engine_id: str = ""
    cache_ttl_seconds: int = 86400
    daily_quota: int = 100

    @property
    def per_page(self) -> int:
        """Results per page clamped to 1..10; blank or zero means 10."""
        try:
            n = int(self.results_per_page or 10)
        except (TypeError, ValueError):
            n = 10
        return max(1, min(10, n))

    @property
    def pages(self) -> int:
        """Pages per sub-query, at least one; blank or zero means 10."""
        try:
            n = int(self.max_pages or 10)
        except (TypeError, ValueError):
            n = 10
        return max(1, n)

    @property
    def supported(self) -> bool:
        """Only organic results can be served from the search API."""
        return bool(self.include_organic) and not (
            self.include_paa or self.include_related or self.include_ads or self.include_ai_overview)
