"""Settings of a grouping run."""

from __future__ import annotations

from dataclasses import dataclass, replace

MAX_THRESHOLD, MAX_EDGE_PAGES, BITS = 16, 10, 64


@dataclass(frozen=True)
class GroupingOptions:
    """What counts as a repeated page worth showing."""

    threshold: int = 0
    min_pages: int = 2
    min_archives: int = 2
    include_flat: bool = False
    skip_first_page: bool = True
    skip_last_page: bool = False
    edge_pages: int = 3

    def check(self) -> GroupingOptions:
        """Raise ValueError for a setting out of its range."""
        for name, low, high in (("threshold", 0, MAX_THRESHOLD), ("min_pages", 2, None), ("min_archives", 1, None), ("edge_pages", 1, MAX_EDGE_PAGES)):
            value = getattr(self, name)
            if isinstance(value, bool) or value < low or (high is not None and value > high):
                raise ValueError(f"{name} must be {low} or more" + (f" and {high} or less" if high is not None else "") + f", not {value}")
        return self


#: Ready-made matching settings. Fixed values.
PRESETS = {"strict": GroupingOptions(), "ads": GroupingOptions(threshold=6), "one_book": GroupingOptions(min_archives=1)}


def matching_preset(options: GroupingOptions) -> str | None:
    """The preset that equals the settings but for the edge window, if any."""
    return next((n for n, p in PRESETS.items() if replace(p, edge_pages=options.edge_pages) == options), None)


def check_run(max_fraction: float, *, choose_all: bool = False, groups: tuple[str, ...] = (), known_only: bool = False) -> None:
    """Refuse a limit out of (0, 1], no choice of groups, and choices that contradict each other."""
    if not 0 < max_fraction <= 1:
        raise ValueError(f"the largest share must be over 0 and at most 1, not {max_fraction}")
    if sum((choose_all, bool(groups), known_only)) != 1:
        raise ValueError("choose all groups, some by id, or known ones")
