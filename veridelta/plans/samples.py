"""Literal inputs of registered queries."""

from __future__ import annotations

#: answer, similarity, explanation; None: no usable object
VERDICTS = [
    ('{"similarity": 0.5, "explanation": "other date"}', 0.5, "other date"),
    ('```json\n{"similarity": 1.5, "explanation": " equivalent "}\n```', 1.0, "equivalent"),
    ('Here: {"similarity": -2}', 0.0, ""),
    ('{"similarity": NaN, "explanation": "?"}', 1.0, "?"),
    ('{"explanation": "none"}', None, None),
    ("no object", None, None),
    ('{"similarity": "0.25", "explanation": "as text"}', 0.25, "as text"),
]
