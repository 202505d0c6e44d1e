"""Values that the queries' SQL is checked with, stated apart from the library's own lists."""

from __future__ import annotations

#: Words left out when titles are compared.
MATCH_STOP = [
    "the", "a", "an", "and", "or", "but", "nor", "so", "yet",
    "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "over", "after", "before", "between", "under", "during",
    "will", "be", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did", "done", "can", "could", "would", "should", "may", "might", "must",
    "this", "that", "these", "those", "it", "its", "they", "them", "their", "what", "which", "who", "whom", "whose", "how", "when", "where", "why",
    "market", "prediction", "price", "outcome",
]
#: Words left out of settlement rules.
RULE_STOP = [
    "the", "a", "an", "and", "or", "but", "nor", "so", "yet", "in", "on", "at", "to", "for", "of", "with", "by", "from",
    "will", "be", "is", "are", "was", "were", "been", "being", "have", "has", "had", "do", "does", "did", "done",
    "this", "that", "these", "those", "it", "its", "they", "what", "which", "who", "when", "where", "why", "how", "yes", "no", "not", "more", "than", "before", "after",
]
#: Words that leave a settlement to judgement.
SUBJECTIVE = ["reasonable", "consensus", "mainstream", "general", "widely", "common", "typical", "standard", "normal", "appropriate", "significant", "substantial"]
#: What the themed questions of the category query come under.
CATEGORY = {"Senate vote ": "Politics", "GDP of ": "Economics", "NBA finals ": "Sports", "OpenAI and ": "Technology", "Bitcoin ": "Crypto", "Hurricane ": "Climate", "Grammy ": "Entertainment", "Ceasefire ": "Geopolitics", "Vaccine ": "Health", "Pope ": "World"}
