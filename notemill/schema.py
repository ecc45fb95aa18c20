"""Fixed values of the note domain, tunables and row types."""

from __future__ import annotations

from dataclasses import dataclass, field

# Result equality depends on them.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "my", "of", "on", "or", "that",
    "the", "to", "we", "what", "when", "where", "which", "who", "with", "you",
)
HISTORY_HINTS = ("history", "closed", "past")
PREFERENCE_HINTS = ("preference", "preferences", "style", "workflow", "habit", "habits", "tools", "editors", "editor")
LOOP_HINTS = ("loop", "loops", "unresolved", "next", "pending", "todo", "task", "tasks", "do")
SECTION_ALIASES = {
    "next actions": "next action", "next steps": "next action", "next step": "next action",
    "question task": "question or task", "why matters": "why it matters",
}
SCOPES = ("home", "work", "dev", "personal", "life", "meta", "all")
STATUSES = ("open", "closed", "blocked", "snoozed")
SOURCES = ("user", "tool", "assistant", "inferred")
LANGS = ("en", "no", "mixed")
TYPE_DIRS = {"01_identity": "id", "02_facts": "fact", "03_preferences": "pref", "04_goals": "goal", "05_open_loops": "loop", "06_concepts": "concept"}
ACTIONS = ("created", "updated", "archived", "deleted", "closed", "sleep")
SIGNAL_TYPES = ("retrieval_hit", "retrieval_miss", "correction", "affirmation", "stale_flag", "preference_applied", "rating")

MODES = ("legacy", "two_stage", "scope_type_prefilter", "precomputed_index", "progressive_disclosure", "semantic_hybrid")


@dataclass(frozen=True)
class Settings:
    """Every number that ranking and analytics take from configuration."""

    bm25: float = 0.30
    lexical: float = 0.15
    tag: float = 0.15
    scope: float = 0.15
    recency: float = 0.15
    confidence: float = 0.10
    signal: float = 0.0
    identity_boost: float = 0.15
    hybrid_vector: float = 0.55
    hybrid_lexical: float = 0.30
    hybrid_scope: float = 0.10
    hybrid_recency: float = 0.05
    recency_days: float = 90.0
    shortlist_min: int = 24
    shortlist_max: int = 36
    shortlist_multiplier: int = 3
    detailed_reasons: int = 20
    rationale_top: int = 3
    signal_min_entries: int = 20
    boot_min_confidence: float = 0.8
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    bundle_words: int = 1200
    bundle_least: int = 40
    bundle_most: int = 200
    import_files: int = 50
    import_notes: int = 100
    import_write: float = 0.90
    import_queue: float = 0.70
    bucket_caps: dict[str, int] = field(default_factory=lambda: {"journal-archive": 5, "journal": 20})
    hit_at_k: float = 0.80
    mrr: float = 0.65

    def shortlist(self, limit: int) -> int:
        return max(self.shortlist_min, min(self.shortlist_max, max(1, limit) * self.shortlist_multiplier))


DEFAULTS = Settings()

NOTE_FILE = "path string, text string, mtime timestamp, size long"
SIGNAL = "ts string, type string, note string, query string, detail string, rating int, session string"
TIMELINE = "ts string, action string, path string, desc string, type string, activity_type string"
