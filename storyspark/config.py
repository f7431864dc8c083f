"""Defaults, and word lists, as one frozen value that is passed explicitly."""

from __future__ import annotations

from dataclasses import dataclass

# Word lists that results depend on.
SIMILARITY_STOP_WORDS = """
a an the and or but in on at to for of with by from as is are was were be been being it its this that these those
after over into about says say said today latest new
""".split()
RELEASE_WORDS = """
launch launches launched announce announces announced announcement release releases released unveil unveils unveiled
introduce introduces introduced debut debuts roll rolls rolled
""".split()
UPDATE_WORDS = "update updates updated".split()
QUESTION_STOP_WORDS = """
what whats when where which who whom whose why how has have had this that these those with from into about after before
since over under again further then once here there all any both each few more most other some such only own same than
too very can will just don should now the and for are was were been being show tell give make does did doing happened
happen story stories news today yesterday major different covering compare reported report event important importance
involved company companies source sources changed change changes
""".split()
EVAL_STOP_WORDS = """
the a an and or to of in on for with by as at is are was were be been that this it its from after before into over under
not no yes said says report reports reported according
""".split()
TRACKING_PARAMS = "utm_source utm_medium utm_campaign utm_term utm_content utm_id fbclid gclid mc_cid mc_eid ref".split()


@dataclass(frozen=True)
class Config:
    weight_relevance: float = 0.35
    weight_freshness: float = 0.25
    weight_diversity: float = 0.2
    weight_quality: float = 0.2
    near_duplicate_threshold: float = 0.85
    cluster_threshold: float = 0.5
    half_life_hours: float = 24.0
    diversity_saturation: int = 5
    tier_scores: tuple[float, float, float] = (1.0, 0.7, 0.4)
    recency_hours: int = 48
    max_articles: int = 50
    max_stories: int = 15
    max_summaries: int = 8
    summary_articles: int = 6
    url_overlap: float = 0.25
    send_attempts: int = 3
    retrieval_n: int = 8
    retrieval_min: float = 0.15

    def __post_init__(self) -> None:
        """Gaps between tier scores are 0 or more than 0.15; then preferring the better tier is a total order."""
        s = self.tier_scores
        if any(0 < abs(a - b) <= 0.15 for a in s for b in s):
            raise ValueError("tier scores must be equal or more than 0.15 apart")
