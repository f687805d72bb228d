"""Settings of a job."""

from __future__ import annotations

from dataclasses import dataclass

OUTPUT_TYPES = ("TEXT", "JSON")


@dataclass(frozen=True)
class SequenceParams:
    """What to mine and where to put it.

    ``min_seq`` and ``max_seq`` bound the windows counted in the first phase; a window holds the
    search query and its topics.  Reports show sequences of ``min_seq`` to ``max_seq - 1`` topics.
    ``window_max`` overrides the longest window; left unset it is ``max_seq``, or ``max_seq + 1``
    when counting by hour.  ``session_threshold``, in seconds, starts a new session where two events
    are further apart; unset, sessions are those of the log.  ``keep_tags`` leaves the marks of searches and topics in text reports.
    """

    action: str = "SearchTopics"
    min_seq: int = 2
    max_seq: int = 5
    raw_folder: str = ""
    results_folder: str = ""
    results_limit: int = 500
    output_type: str = "JSON"
    window_max: int | None = None
    min_unit_support: int = 2
    keep_tags: bool = False
    session_threshold: int | None = None

    def __post_init__(self) -> None:
        if self.min_seq < 1:
            raise ValueError("min_seq must be at least 1")
        if self.max_seq <= self.min_seq:
            raise ValueError("max_seq must be above min_seq")
        if self.results_limit < 1:
            raise ValueError("results_limit must be at least 1")
        if self.min_unit_support < 1:
            raise ValueError("min_unit_support must be at least 1")
        if self.session_threshold is not None and self.session_threshold < 1:
            raise ValueError("session_threshold must be at least 1")
        if self.window_max is not None and self.window_max < self.min_seq:
            raise ValueError("window_max must not be below min_seq")
        if self.output_type not in OUTPUT_TYPES:
            raise ValueError(f"output_type must be one of {OUTPUT_TYPES}")

    def longest_window(self, by_hour: bool = False) -> int:
        if self.window_max is not None:
            return self.window_max
        return self.max_seq + 1 if by_hour else self.max_seq

    @property
    def job_folder(self) -> str:
        return f"{self.results_folder.rstrip('/')}/{self.action}"
