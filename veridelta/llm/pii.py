"""Personal data by weak supervision, with DataFrame functions only.

Base spans are exact formats (email, ip, card with Luhn, phone) and always stay.  Weaker
candidates (spelled-out addresses, national phone numbers, grouped long numbers, identity
numbers, keys and tokens, account numbers) come from further patterns.  Three labelers vote
+1, 0 or -1 on every candidate of either sort alike: a stricter form of the kind, with its
check digits where it has some (regex), lists of known domains, ranges, prefixes and lengths
(gazetteer), and words before the span (context).  Only the counts of vote patterns, a table whose size is fixed
by the number of kinds and votes, reach the driver: expectation-maximisation (Dawid and
Skene, 1979) estimates each labeler's reliability there, and a logistic span classifier is
trained on the posteriors with votes and surface features.  Its weights are literals in the
expression that accepts or rejects the weaker candidates.

A regular expression gives no positions: the text is split by it too, and lengths of gaps
and matches add up to code-point offsets.  Patterns use possessive loops and fixed look-
behinds, so that long runs neither recurse nor rescan.

Defined cases: null and empty texts have no spans (very long ones are read whole); every row is answered on its own, with
null and repeated ids too; other columns pass through `annotate`, which replaces `pii_`
columns only; an empty table gives no rows and accepts no weaker candidates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "id", "secret", "iban")
_SPAN = "array<struct<start:int,end:int,text:string,before:string>>"
_LOCAL = "A-Za-z0-9._%+-"
#: \G: also right after a match, where a look-behind would see the match's last character
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![0-9])(?![\x20-][0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: what a text must contain for a pattern to match; saves the scan
_SIGN = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9]", "phone": "\\+[0-9]"}
WEAK = {
    "email": rf"(?i)(?<![{_LOCAL}])[a-z0-9._%+-]++(?: ?[\[({{]at[\])}}] ?| at )[a-z0-9-]++(?: ?[\[({{]dot[\])}}] ?| dot )[a-z]{{2,6}}(?![a-z])",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-. ])[0-9]{3}[-. ][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9-])[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{1,4}(?![0-9])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "secret": r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,200}+(?![A-Za-z0-9_-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
#: what a text must match for a weaker pattern to be searched for
_WEAK_SIGN = {"email": "(?i)[^a-z]dot[^a-z]", "phone": "[0-9]{3}[-. ][0-9]{4}", "card": "[0-9]{4}[ -][0-9]", "id": "[0-9]-[0-9]{2}-[0-9]", "secret": "[A-Za-z][0-9][A-Za-z0-9]|[0-9][A-Za-z]", "iban": "[A-Z]{2}[0-9]{2}"}
#: regex labeler: forms for and against; card and iban are decided by their check digits
STRICT = {
    "email": (r"^[A-Za-z0-9](?:[A-Za-z0-9_%+-]|[.](?![.]))*(?:@| ?[\[({]).*[A-Za-z]{2,6}$", r"\.\.|^[.]|@-|[0-9]$"),
    "ip": (r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", r"(?:^|\.)0[0-9]"),
    "phone": (r"^(?:\+[0-9]{1,3}[ (.-]|\([0-9]{3}\)|[2-9][0-9]{2}([-. ])[2-9][0-9]{2}\1)", r"\.[0-9]{1,2}\.|([0-9])\1{6}"),
    "id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", r"^(?:000|666|9)|-00-|-0000$|([0-9])\1\1-\1\1-\1{4}"),
    "secret": (r"^(?=(?:[^0-9]*+[0-9]){6})(?=(?:[^A-Za-z]*+[A-Za-z]){4})", r"^(?:[a-z]+[-_])+[0-9]*$|[-_]{3}|^[0-9-]+$"),
}
GAZETTEER = {
    "email": (r"(?i)[. ](com|org|net|edu|gov|info|io|de|fr|es|uk|eu)$", r"(?i)@(localhost|invalid)"),
    "ip": (r"^(?!0|127\.|255\.)([1-9][0-9]?|1[0-9]{2}|2[01][0-9]|22[0-3])\.", r"^(0|127|255)\."),
    "card": (r"^(4|5[1-5]|2[2-7]|3[4-7]|6011|65)", r"^0"),
    "phone": (r"^(\+(1|33|34|44|49)\b|\(?[2-9][0-9]{2})", r"^\+0"),
    "id": (r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)", r"^(000|666|9)"),
    "secret": (r"^(AKIA|ASIA|ghp_|gho_|glpat-|sk_live_|sk-|xox[abp]-|AIza|eyJ)|^([0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$", r"(?i)0123456789|abcdefgh|(.)\\1{7}|example|sample"),
    "iban": (r"^(AT|BE|CH|CZ|DE|DK|ES|FI|FR|GB|IE|IT|LU|NL|NO|PL|PT|SE)", r"^(XX|ZZ|AA)"),
}
CONTEXT = {
    "email": r"(?i)(e-?mail|mail|contact|write|correo|kontakt|courriel)\W*(\w+\W+)?$",
    "ip": r"(?i)\b(ip|address|host|server|adresse)\W*(\w+\W+)?$",
    "card": r"(?i)\b(card|visa|mastercard|credit|debit|payment|carte|karte|tarjeta)\W*(\w+\W+)?$",
    "phone": r"(?i)\b(tel|phone|call|fax|mobile|cell|telefon|t.l.phone)\W*(\w+\W+)?$",
    "id": r"(?i)\b(ssn|social security|security number|identity|passport)\W*(\w+\W+)?$",
    "secret": r"(?i)(token|secret|passw(or)?d|pwd|api[_ -]?key|\bkey|auth|bearer|credentials?)\W*$",
    "iban": r"(?i)\b(iban|account|konto|compte|cuenta|bank)\W*(\w+\W+)?$",
}
AGAINST = r"(?i)\b(version|serial|order|isbn|invoice|build|release|section|commit|checksum|digest|hash|sha-?(1|256)|md5|etag|uuid|no\.)\W*$"


def _found(text: Column, regex: str, sign: str) -> Column:
    """Matches of the pattern with code-point offsets and the characters before them."""
    m, g = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    none = F.array().cast(_SPAN)

    def step(a: Column, i: Column) -> Column:
        gap, match = F.get(g_, i), F.get(m_, i)
        at = a["pos"] + F.length(gap)
        own = F.struct(at.alias("start"), (at + F.length(match)).alias("end"), match.alias("text"), F.right(gap, F.lit(32)).alias("before"))
        return F.struct((at + F.length(match)).alias("pos"), F.concat(a["out"], F.array(own).cast(_SPAN)).alias("out"))

    # m and g are evaluated once: they are bound as the only element of an array
    both = F.array(F.struct(m.alias("m"), g.alias("g")))
    m_ = g_ = None

    def bound(b: Column) -> Column:
        nonlocal m_, g_
        m_, g_ = b["m"], b["g"]
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        return F.when(F.size(m_) > 0, F.aggregate(F.sequence(F.lit(0), F.size(m_) - 1), start, step, lambda a: a["out"])).otherwise(none)

    spans = F.element_at(F.transform(both, bound), 1)
    return F.when(text.rlike(sign), spans).otherwise(none)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    d = F.reverse(_digits(text))

    def digit(i: Column) -> Column:
        x = F.substr(d, i + 1, F.lit(1)).cast("int")
        twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 1, twice).otherwise(x)

    return F.aggregate(F.transform(F.sequence(F.lit(0), F.length(d) - 1), digit), F.lit(0), lambda a, x: a + x) % 10 == 0


_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
VALID = {
    "email": lambda t: F.lit(True),
    "ip": lambda t: t.rlike(rf"^{_BYTE}\.{_BYTE}\.{_BYTE}\.{_BYTE}$"),
    "card": lambda t: _luhn(t),
    "phone": lambda t: F.length(_digits(t)).between(10, 15),
}


def _mod97(text: Column) -> Column:
    """Whether an account number's check digits hold (ISO 7064): letters count from 10."""
    plain = F.replace(text, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.left(plain, F.lit(4)))

    def step(a: Column, c: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (a * F.when(value >= 10, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _strict(kind: str, text: Column) -> Column:
    if kind in ("card", "iban"):
        holds = (_luhn if kind == "card" else _mod97)(text)
        return _vote(holds, ~holds)
    yes, no = STRICT[kind]
    return _vote(text.rlike(yes), text.rlike(no))


def _candidate(kind: str, base: bool, s: Column) -> Column:
    """A span with its votes and surface features."""
    yes, no = GAZETTEER[kind]
    return F.struct(
        F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"),
        F.lit(KINDS.index(kind)).alias("ord"), _strict(kind, s["text"]).cast("int").alias("v1"),
        _vote(s["text"].rlike(yes), s["text"].rlike(no)).cast("int").alias("v2"),
        _vote(s["before"].rlike(CONTEXT[kind]), s["before"].rlike(AGAINST)).cast("int").alias("v3"),
        F.least(F.lit(3), F.floor((s["end"] - s["start"]) / 8)).cast("int").alias("len"),
        s["text"].rlike("[^0-9]").cast("int").alias("mixed"),
    )


def _valid(kind: str):
    return lambda s: VALID[kind](s["text"])


def _as(kind: str, base: bool):
    return lambda s: _candidate(kind, base, s)


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _earlier(a: Column, b: Column) -> Column:
    """Order by start, then kind."""
    x, y = (c["start"].cast("long") * 8 + c["ord"] for c in (a, b))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with pii_base and pii_weak: arrays of candidates with their votes."""
    t = F.coalesce(F.col(text), F.lit(""))
    cols = {f"pii_{k}": F.filter(_found(t, regex, _SIGN[k]), _valid(k)) for k, regex in BASE.items()}
    weak = {f"pii_weak_{k}": _found(t, regex, _WEAK_SIGN[k]) for k, regex in WEAK.items()}
    # long words are no keys
    weak["pii_weak_secret"] = F.filter(weak["pii_weak_secret"], lambda s: s["text"].rlike("[0-9].*[0-9]") & s["text"].rlike("[A-Za-z]"))
    d = docs.withColumns(cols | weak)
    base = F.concat(*[F.transform(f"pii_{k}", _as(k, True)) for k in BASE])
    d = d.withColumn("pii_base", F.array_sort(base, _earlier))
    # an account number is no key as well
    d = d.withColumn("pii_weak_secret", F.when(F.size("pii_weak_iban") > 0, F.filter("pii_weak_secret", lambda s: ~F.exists("pii_weak_iban", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(F.col("pii_weak_secret")))
    loose = F.concat(*[F.transform(f"pii_weak_{k}", _as(k, False)) for k in WEAK])
    d = d.withColumn("pii_weak", F.when(F.size(loose) > 0, F.filter(loose, lambda s: ~F.exists("pii_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))).otherwise(loose))
    return d.drop(*cols, *weak)


FEATURES = ("kind", "v1", "v2", "v3", "len", "mixed")


def patterns(annotated: DataFrame) -> dict[tuple, int]:
    """How often each pattern of kind, votes and surface features occurs; at most 7 * 27 * 4 * 2 of them."""
    spans = annotated.select(F.explode(F.concat("pii_base", "pii_weak")).alias("s")).select(*[F.col(f"s.{c}") for c in FEATURES])
    return {tuple(r)[:-1]: r[-1] for r in spans.groupBy(*FEATURES).count().collect()}


def reliabilities(counts: dict[tuple, int], rounds: int = 40) -> tuple[list[dict[int, tuple[float, float]]], dict[tuple, float]]:
    """EM over votes: of each labeler P(vote | not personal), P(vote | personal); and each pattern's posterior."""
    post = {x: 1 / (1 + math.exp(-1.5 * sum(x[1:4]))) for x in counts}
    votes: list[dict[int, tuple[float, float]]] = []
    for _ in range(rounds if counts else 0):
        total = sum(counts.values())
        prior = (1 + sum(n * post[x] for x, n in counts.items())) / (2 + total)
        votes = []
        for j in (1, 2, 3):
            own = {v: [0.5, 0.5] for v in (-1, 0, 1)}
            for x, n in counts.items():
                own[x[j]][1] += n * post[x]
                own[x[j]][0] += n * (1 - post[x])
            sums = [sum(v[z] for v in own.values()) for z in (0, 1)]
            votes.append({v: (c[0] / sums[0], c[1] / sums[1]) for v, c in own.items()})
        for x in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(votes[j][x[j + 1]][1] / votes[j][x[j + 1]][0]) for j in range(3))
            post[x] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return votes, post


def _inputs(x: tuple) -> list[str]:
    return ["bias", f"kind={x[0]}", *[f"v{j}={x[j]}" for j in (1, 2, 3)], f"len={x[4]}", f"mixed={x[5]}"]


def train(counts: dict[tuple, int], rounds: int = 300, l2: float = 1e-3) -> dict[str, float]:
    """Weights of the span classifier, fitted to the posteriors of all patterns by their counts."""
    _, post = reliabilities(counts)
    weights: dict[str, float] = {f: 0.0 for x in counts for f in _inputs(x)}
    total = sum(counts.values()) or 1
    for _ in range(rounds):
        slope = {f: -l2 * w for f, w in weights.items()}
        for x, n in counts.items():
            p = 1 / (1 + math.exp(-sum(weights[f] for f in _inputs(x))))
            for f in _inputs(x):
                slope[f] += n / total * (post[x] - p)
        for f in weights:
            weights[f] += 2.0 * slope[f]
    return weights


def _logit(s: Column, weights: dict[str, float]) -> Column:
    out = F.lit(weights.get("bias", -9.0))
    for name in FEATURES:
        for f, w in weights.items():
            left, _, value = f.partition("=")
            if left == name:
                out = out + F.when(s[name].cast("string") == value, w).otherwise(0.0)
    return out


def accepted(weights: dict[str, float], least: float = 0.5) -> Column:
    """All spans of an annotated row by start, then kind: base ones, and the weaker that the classifier takes."""
    bar = math.log(least / (1 - least))
    weak = F.when(F.size("pii_weak") > 0, F.filter("pii_weak", lambda s: _logit(s, weights) >= bar)).otherwise(F.col("pii_weak"))
    return F.array_sort(F.concat("pii_base", weak), _earlier)


def redacted(spans: Column, text: Column) -> Column:
    """The text with each span, or stretch of overlapping spans, as [KIND]."""
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, s: Column) -> Column:
        grown = F.concat(a["out"], F.array(F.substr(text, a["pos"] + 1, s["start"] - a["pos"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))
        return F.when(s["start"] >= a["pos"], F.struct(s["end"].alias("pos"), grown.alias("out"))).otherwise(F.struct(F.greatest(a["pos"], s["end"]).alias("pos"), a["out"].alias("out")))

    whole = F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substr(text, a["pos"] + 1)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def _listed(spans: Column | str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(annotated: DataFrame, weights: dict[str, float]) -> DataFrame:
    n = {f"n_{k}": F.size(F.filter("pii_base", _of(k))).cast("long") for k in BASE}
    every = F.array(accepted(weights))  # bound once
    out = F.element_at(F.transform(every, lambda s: F.struct(_listed(s).alias("spans"), F.size(s).cast("long").alias("n_spans"))), 1)
    rows = annotated.select("doc_id", *[c.alias(k) for k, c in n.items()], F.sha2(_listed("pii_base").cast("binary"), 256).alias("base_sha256"), out.alias("own"))
    return rows.select("doc_id", *n, "base_sha256", "own.spans", "own.n_spans")
