"""Engine configuration.

Every operator takes a :class:`QAConfig`; nothing reads module globals or the
environment at query time.  ``QAConfig.from_env()`` applies the three
environment overrides the answering service honours.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values.  These must equal the values the answering service uses, or
# answers, routing and the report change.  Listed as plain text, in order.
# ---------------------------------------------------------------------------
PROMPT_PREFIX = "Answer this Python/Data Science question clearly:"
SIMILARITY_THRESHOLD = 0.55
ANSWER_RELEVANCE_THRESHOLD = 0.2
UNCERTAIN_RESPONSE = "I am not confident enough to answer that yet. Please try another wording or consult additional resources."
CONTEXT_BLOCK = "Relevant information:\n"
CONTEXT_QUESTION = "Based on the above information, answer this question:\n"
ANSWER_MARK = "Answer:"
SUPPORTED_FILE_TYPES = (".txt", ".csv", ".md", ".markdown")
MAX_UPLOAD_BYTES = 16 * 1024 * 1024
CHUNK_SIZE = 500
CHUNK_OVERLAP = 50
MAX_FEATURES = 5000
RELEVANCE_MAX_FEATURES = 1000
RETRIEVAL_TOP_K = 3
CONTEXT_TOP_K = 2
CONTEXT_THRESHOLD = 0.2
STRICT_CONTEXT_SCORE = 0.3
HARD_REJECT_RELEVANCE = 0.2
MIN_GENERATED_CHARS = 10
MIN_ANSWER_CHARS = 5
LEAK_SLACK_CHARS = 20
EMPTY_QUESTION_REPLY = "Please provide a question."
PREVIEW_CHARS = 100
# Display labels of the chat page for sources and corpora, and the upload
# rejection messages.
SOURCE_LABELS = {
    "dataset": "Dataset Answer",
    "uploaded": "Uploaded File Answer",
    "llm": "Generated Answer",
    "uncertain": "Low Confidence",
}
DATASET_SOURCE_NAMES = {
    "main_dataset": "Main Curated Dataset",
    "uploaded_files": "Uploaded Files",
    "llm_fallback": "LLM Fallback",
    "none": "No Source",
}
UPLOAD_NO_NAME = "No file selected"
UPLOAD_BAD_TYPE = "Unsupported file type. Supported types: .txt, .csv, .md, .markdown"
UPLOAD_TOO_LARGE = "File size exceeds 16MB limit"
UPLOAD_EMPTY = "Failed to process file"
# Score digits: cosine sums are added in different orders by different
# engines, so scores are rounded before they are ranked or compared.
SCORE_DIGITS = 6


@dataclass(frozen=True)
class QAConfig:
    similarity_threshold: float = SIMILARITY_THRESHOLD
    relevance_threshold: float = ANSWER_RELEVANCE_THRESHOLD
    uncertain_response: str = UNCERTAIN_RESPONSE
    prompt_prefix: str = PROMPT_PREFIX
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = CHUNK_OVERLAP
    max_features: int = MAX_FEATURES
    relevance_max_features: int = RELEVANCE_MAX_FEATURES
    top_k: int = RETRIEVAL_TOP_K
    context_top_k: int = CONTEXT_TOP_K
    context_threshold: float = CONTEXT_THRESHOLD
    strict_context_score: float = STRICT_CONTEXT_SCORE
    hard_reject_relevance: float = HARD_REJECT_RELEVANCE
    score_digits: int = SCORE_DIGITS
    supported_file_types: tuple = SUPPORTED_FILE_TYPES
    max_upload_bytes: int = MAX_UPLOAD_BYTES
    # Upper bound on rows of a side that may be broadcast in a join.  Sides
    # are counted before the hint is given; larger sides take a salted
    # shuffle join instead.
    broadcast_row_limit: int = 2_000_000
    # Number of salt values used to spread a hot join key (a frequent term)
    # over several tasks when the query side is too large to broadcast.
    join_salt: int = 16
    # pandas-compatible null tokens for the Q&A CSV reader.  Default: only
    # the empty cell is null (documented difference, see README).
    null_tokens: tuple = ("",)
    extra: dict = field(default_factory=dict, compare=False, hash=False)

    def __post_init__(self):
        if self.chunk_overlap > self.chunk_size * 0.5:
            raise ValueError("chunk_overlap must be at most half of chunk_size")
        if self.chunk_size < 1 or self.chunk_overlap < 0:
            raise ValueError("chunk_size must be positive, overlap non-negative")
        if self.top_k < 1 or self.context_top_k < 1:
            raise ValueError("top_k must be at least 1")
        if self.similarity_threshold <= 0 or self.context_threshold <= 0:
            raise ValueError("thresholds must be positive")

    def with_(self, **kw) -> "QAConfig":
        return replace(self, **kw)

    @classmethod
    def from_env(cls) -> "QAConfig":
        kw = {}
        if "SIMILARITY_THRESHOLD" in os.environ:
            kw["similarity_threshold"] = float(os.environ["SIMILARITY_THRESHOLD"])
        if "ANSWER_RELEVANCE_THRESHOLD" in os.environ:
            kw["relevance_threshold"] = float(os.environ["ANSWER_RELEVANCE_THRESHOLD"])
        if "UNCERTAIN_RESPONSE" in os.environ:
            kw["uncertain_response"] = os.environ["UNCERTAIN_RESPONSE"]
        return cls(**kw)


DEFAULT = QAConfig()
