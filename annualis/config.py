"""Fixed values that results depend on, and their dimension-table form.

Everything in the block below is a fixed value: patterns, word lists, questions and
rules whose exact text decides what the operators return.  They are stated once,
in their natural order.  Java regex flavour (Spark) is used; ``(?U)`` gives Unicode
``\\w``/``\\b`` like Python's ``re``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ----------------------------------------------------------------------------------
# FIXED VALUES (must equal the reference behaviour)
# ----------------------------------------------------------------------------------

# Category questions.
QUESTIONS = {
    "revenue_driver": "Which product or service was revenue growth driven by?",
    "margin_driver": "What primarily improved gross margin?",
    "opex_driver": "What primarily increased operating expenses?",
}

# Segment keywords (segment -> keywords).
SEGMENTS = {
    "cloud": ["azure", "intelligent cloud", "other cloud services"],
    "office": ["office 365", "microsoft 365", "office commercial"],
    "search": ["search", "news advertising", "revenue per search"],
    "xbox": ["xbox", "game pass"],
    "windows": ["windows oem", "windows commercial", "windows"],
    "iphone": ["iphone"],
}

# Driver phrase patterns of the config file, in order (first hit wins).
DRIVER_REGEX = [
    r"(?:driven by|led by|primarily by|resulting from|due to|because of)\s+([^.;:]+)",
    r"increased\s+[^.]*?\bdriven by\s+([^.;:]+)",
    r"grew\s+[^.]*?\bdriven by\s+([^.;:]+)",
]
# Pattern used when no config is present.
DEFAULT_DRIVER_REGEX = [r"(?:driven by|led by|due to)\s+([^.;:\n]+)"]

# Candidate cues, in order; each cue phrase must be followed by one of , . ; or " and ".
CANDIDATE_CUES = ["driven by", "led by", "primarily by", "resulting from", "due to", "because of"]
CANDIDATE_TAIL = r"([^.]+?)(?:[,.;]| and )"

# Sentence delimiter.
SENTENCE_SPLIT = r"[.!?•;]\s+"

# Category anchors and their token windows.
ANCHORS = {
    "revenue_driver": (r"\b(revenue|sales)\b", 8),
    "margin_driver": (r"\b(gross margin|margin)\b", 12),
    "opex_driver": (
        r"\b(operating expenses|opex|research and development|r&d|sales and marketing|s&m|"
        r"general and administrative|g&a)\b",
        12,
    ),
}

# Subject groups (matched on the text before the cue).
SUBJECT_GROUPS = {
    "search": r"\b(search|search and news advertising|advertising)\b",
    "office": r"\b(office 365|microsoft 365|office|office commercial)\b",
    "xbox": r"\b(xbox|game pass|xbox game pass)\b",
    "windows": r"\b(windows|windows oem|windows commercial)\b",
    "cloud": r"\b(cloud services|microsoft cloud|server products|intelligent cloud)\b",
    "iphone": r"\b(iphone)\b",
}
# Candidate groups (matched on the phrase).
CANDIDATE_GROUPS = {
    "search": r"\b(search|search and news advertising|advertising)\b",
    "office": r"\b(office 365|microsoft 365|office commercial)\b",
    "xbox": r"\b(xbox|game pass|xbox game pass)\b",
    "windows": r"\b(windows|windows oem|windows commercial)\b",
    "cloud": r"\b(azure|cloud services|microsoft cloud|server products)\b",
    "iphone": r"\b(iphone)\b",
}
GROUP_NAMES = ["search", "office", "xbox", "windows", "cloud", "iphone"]

# Category predicates of the evaluation scripts (regex form).
CUE_ANY = r"(driven by|led by|primarily by|resulting from|due to|because of)"
CATEGORY_REGEX = {
    "revenue_driver": r"\b(revenue|sales)\b",
    "margin_driver": r"\b(gross margin|margin)\b",
    "opex_driver": r"\b(operating expenses|opex|research and development|sales and marketing|general and administrative)\b",
}
# Category predicates of the training script (substring form).
TRAIN_CUES = ["driven by", "led by", "due to"]
TRAIN_CATEGORY_WORDS = {
    "revenue_driver": ["revenue", "sales"],
    "margin_driver": ["margin"],
    "opex_driver": ["operating expenses", "r&d", "sales and marketing", "general and administrative"],
}

# Seed answers of the eval-set builder, per category, in order.
EVAL_SEED_KEYS = {
    "revenue_driver": ["azure", "office 365", "search", "xbox game pass", "iphone"],
    "margin_driver": ["improvement across our cloud services", "improvement in productivity", "improvement in azure"],
    "opex_driver": ["headcount - related expenses"],
}

# Answer group of a canonical answer: ordered (group, substrings).
ANSWER_GROUPS = [
    ("cloud", ["azure", "cloud services", "microsoft cloud", "server products", "intelligent cloud"]),
    ("office", ["office", "microsoft 365"]),
    ("search", ["search"]),
    ("xbox", ["xbox", "game pass"]),
    ("windows", ["windows"]),
    ("iphone", ["iphone"]),
]

# Canonicalisation: ordered substitutions, then ordered prefix removals, then one doubled word.
CANON_SUBSTITUTIONS = [
    (r"\bsearch and news advertising\b", "search"),
    (r"(?<!xbox )game pass\b", "xbox game pass"),
    (r"\boffice\s*365\s*commercial\b", "office 365"),
    (r"\bmicrosoft\s*365\b", "office 365"),
    (r"\boffice\s*commercial\b", "office 365"),
    (r"\bwindows\s*oem\b", "windows"),
    (r"\bwindows\s*commercial\b", "windows"),
    (r"\bazure and other cloud services\b", "azure"),
    (r"\bserver products\b", "server products"),
    (r"\bcloud services\b", "cloud services"),
    (r"\biphone(?: net sales)?\b", "iphone"),
    (r"\bhigher revenue per search\b", "search"),
    (r"\bgrowth in xbox game pass subscriptions\b", "xbox game pass"),
]
CANON_PREFIXES = [
    r"^growth in\s+",
    r"^higher (revenue|net sales) of\s+",
    r"^(increase[s]?|decrease[s]?|improvement[s]?) in\s+",
]
CANON_DOUBLED_WORD = (r"\b(\w+)\s+\1\b", "$1")

# Stop words of the answer-quality tokenizer.
STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "for", "nor", "beyond", "on", "in", "at", "to", "from", "by",
    "of", "with", "as", "is", "are", "was", "were", "be", "been", "being", "that", "this",
    "it", "its", "their", "his", "her", "our", "your", "my",
]

# Chunking: window of 256 tokens, 40 tokens of overlap.
CHUNK_TOKENS = 256
CHUNK_OVERLAP = 40
# Context budgets.
MAX_CONTEXT_CHARS = 6000
PACK_TOKEN_LIMIT = 480
RERANK_KEEP = 5
DEFAULT_TOP_K = 5
NO_CONTEXT_ANSWER = "I couldn't find relevant context locally."
SNIPPET_CHARS = 280
SNIPPET_ELLIPSIS = "…"
# Request de-dup TTL and rate limits.
CACHE_TTL_SECONDS = 600
CACHE_NAMESPACE = "q:v1"  # key = "<app>:" + namespace + ":" + sha1(payload); app prefix is a parameter
RATE_PER_MINUTE = 10
RATE_PER_SECOND = 2
# Prompt of the text-generation path.
PROMPT_TEMPLATE = (
    "Answer strictly from the context. Use one short noun phrase (3–8 words). "
    "If uncertain, say 'not found in context'.\n\n"
    "Context:\n{ctx}\n\nQuestion: {q}\nAnswer:"
)

# Feature names of the learned selector, in order.
FEATURE_NAMES = [
    "bias", "ctx_rank", "ctx_rank_inv", "ce_score", "len_words", "subj_any",
    "g_search", "g_office", "g_xbox", "g_windows", "g_cloud", "g_iphone",
    "align", "cat_rev", "cat_margin", "cat_opex",
]

# Cue sentences appended to the synthetic prose for the derived filings view (ours).
CUE_SENTENCES = [
    "Search revenue grew 9%, driven by search and news advertising, with steady demand. ",
    "Cloud services revenue increased, led by azure and other cloud services in all regions. ",
    "Gross margin rose due to improvement in azure, partly offset by mix. ",
    "Operating expenses increased primarily by headcount - related expenses, and travel. ",
    "Sales rose driven by iphone net sales",
    "Results were mixed because of weather, and nothing else. ",
    "Windows revenue fell due to xbox game pass, an odd pairing. ",
    "Revenue grew driven by office 365 commercial , as planned. ",
    "Sales moved resulting from game pass, and led by windows oem, together. ",
    "Revenue in the first of the many long and winding periods under review here was driven by azure, finally. ",
    "• Xbox revenue grew driven by growth in xbox game pass subscriptions, • other. ",
    "No cue here. ",
]

# ----------------------------------------------------------------------------------
# Dimension tables built from the fixed values (bounded by construction)
# ----------------------------------------------------------------------------------


def segments_df(spark: SparkSession) -> DataFrame:
    rows = [(seg, kw.lower(), i) for seg, kws in SEGMENTS.items() for i, kw in enumerate(kws)]
    return spark.createDataFrame(rows, "segment string, keyword string, kw_pos int")


def questions_df(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUESTIONS.items()), "category string, question string")


def driver_patterns_df(spark: SparkSession, patterns: list[str] | None = None) -> DataFrame:
    pats = patterns or DRIVER_REGEX
    return spark.createDataFrame([(i, p) for i, p in enumerate(pats)], "patt_pos int, pattern string")


def keywords_array() -> list[str]:
    """Distinct lower-cased segment keywords (the reference uses a set)."""
    out: list[str] = []
    for kws in SEGMENTS.values():
        for k in kws:
            if k.lower() not in out:
                out.append(k.lower())
    return out


def cue_sentences_col() -> "F.Column":
    return F.array(*[F.lit(s) for s in CUE_SENTENCES])


SCHEMA_CANDIDATE = T.StructType(
    [
        T.StructField("phrase", T.StringType()),
        T.StructField("sentence", T.StringType()),
        T.StructField("ctx_rank", T.IntegerType()),
        T.StructField("ce_score", T.DoubleType()),
        T.StructField("subj_groups", T.ArrayType(T.StringType())),
        T.StructField("cand_groups", T.ArrayType(T.StringType())),
    ]
)
