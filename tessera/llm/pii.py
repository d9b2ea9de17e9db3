"""Personal data by weak supervision, in DataFrame and SQL expressions only.

Regex, checksum, gazetteer and context labelers vote on candidate spans. Expectation-maximisation
over the counts of vote patterns estimates each labeler's reliability without labels; its posteriors
train a logistic span classifier, which is scored as a SQL expression.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import keep

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("regex", "check", "gazetteer", "context")
CONTEXT = 40

# Matches of the base patterns. Possessive loops and the start anchors only spare the engine work:
# a match can begin nowhere else and never needs to give a character back.
_LOCAL, _HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Further candidates: written-out addresses, long IPv6 forms, 13-digit runs, numbers without a plus.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[(\[{{](?i:at)[)\]}}]\x20?{_HOST}++(?:\x20?(?:\.|[(\[{{](?i:dot)[)\]}}])\x20?{_HOST}++)++",
    "ip": r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": BASE["card"],
    "phone": r"(?<![0-9A-Za-z+().-])(?:00[0-9]{1,3}[\x20.-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
}
#: What a text must have for a pattern to be worth running; each is implied by a match.
GUARD = {
    "email": "contains(text, '@')",
    "ip": r"text RLIKE r'[0-9]\.[0-9]'",
    "card": r"text RLIKE r'[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]'",
    "phone": "contains(text, '+')",
    "email_loose": r"text RLIKE r'[(\[{][aA][tT][)\]}]'",
    "ip_loose": r"text RLIKE r'[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]'",
    "phone_loose": r"text RLIKE r'[0-9]{3}[\x20.-][0-9]{4}'",
}
# Gazetteers, fixed values.
TLDS = "com org net edu gov mil int info biz io co app dev ai de at ch fr be es pt it nl uk ie us ca mx br ar cl au nz jp cn kr in ru pl cz se no dk fi gr tr za eu"
CALLING_CODES = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"
CARD_PREFIX = r"^(4|5[1-5]|2[2-7]|3[4-8]|6011|6[45]|62)"
RESERVED_IP = r"^(0+\.|127\.|255\.|22[4-9]\.|2[34][0-9]\.)"
NEAR = {
    "email": "mail contact write reply kontakt correo courriel adresse",
    "ip": "ip host server address addr client serveur servidor from login",
    "card": "card visa master amex credit debit karte tarjeta carte pay",
    "phone": "phone tel call mobile cell fax telefon telefono anruf appel llamar whatsapp",
}
AGAINST = "version isbn issn release build invoice order rechnung pedido commande part serial"


def _match_list(kind: str, pattern: str, guard: str) -> str:
    return f"CASE WHEN {guard} THEN regexp_extract_all(text, r'{pattern}', 0) ELSE CAST(array() AS array<string>) END AS m_{kind}"


def _gap_list(kind: str, pattern: str) -> str:
    return f"CASE WHEN size(m_{kind}) > 0 THEN split(text, r'{pattern}') END AS g_{kind}"


def _place_list(kind: str) -> str:
    """Matches with places in code points: the lengths of gaps and matches, added up."""
    empty = "CAST(array() AS array<struct<s:int,e:int,m:string>>)"
    return f"""CASE WHEN size(m_{kind}) > 0 THEN aggregate(m_{kind}, named_struct('i', 0, 'p', length(g_{kind}[0]), 'o', {empty}),
        (a, x) -> named_struct('i', a.i + 1, 'p', a.p + length(x) + length(g_{kind}[a.i + 1]),
                               'o', concat(a.o, array(named_struct('s', a.p, 'e', a.p + length(x), 'm', x)))), a -> a.o) ELSE {empty} END AS p_{kind}"""


def _digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def _luhn(m: str) -> str:
    d = f"reverse({_digits(m)})"
    return f"""aggregate(transform(sequence(1, length({d})), i -> CAST(substr({d}, i, 1) AS int) * IF(i % 2 = 0, 2, 1)), 0, (a, v) -> a + IF(v > 9, v - 9, v)) % 10 = 0"""


_OCTET = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
VALID = {
    "email": "true",
    "ip": rf"x.m RLIKE r'^{_OCTET}(\.{_OCTET}){{3}}$'",
    "card": f"length({_digits('x.m')}) BETWEEN 14 AND 19 AND {_luhn('x.m')}",
    "phone": f"length({_digits('x.m')}) BETWEEN 10 AND 15",
}


def _words(words: str) -> str:
    return "|".join(words.split())


def _votes(kind: str, strict: bool) -> str:
    """The struct of a candidate x of a text: place, whether it is a base span, and the four votes."""
    near = f"lower(substring(text, greatest(x.s - {CONTEXT}, 0) + 1, least(x.s, {CONTEXT})))"
    base = VALID[kind] if strict else "false"
    if kind == "email":
        check = r"IF(x.m RLIKE r'[A-Za-z]{2,}$', 1, -1)"
        gazetteer = rf"IF(lower(x.m) RLIKE r'[.)\x20\]}}]({_words(TLDS)})$', 1, 0)"
    elif kind == "ip":
        check = f"IF({VALID['ip']}, 1, -1)" if strict else "1"
        gazetteer = f"IF(x.m RLIKE r'{RESERVED_IP}', -1, 1)" if strict else "IF(lower(x.m) RLIKE '^(2[0-9a-f]{3}|fd|fe80)', 1, 0)"
    elif kind == "card":
        check = f"IF({_luhn('x.m')}, 1, -1)"
        gazetteer = f"IF({_digits('x.m')} RLIKE r'{CARD_PREFIX}', 1, -1)"
    else:
        check = f"IF({VALID['phone']}, 1, -1)"
        gazetteer = f"IF({_digits('x.m')} RLIKE '^(00)?({_words(CALLING_CODES)})', 1, 0)" if strict else r"IF(x.m RLIKE r'^(00|\(?[2-9])', 1, -1)"
    return f"""named_struct('kind', {KINDS.index(kind)}, 's', x.s, 'e', x.e, 'base', {base}, 'v_regex', {1 if strict else 0},
        'v_check', {check}, 'v_gazetteer', {gazetteer},
        'v_context', CASE WHEN {near} RLIKE '{_words(NEAR[kind])}' THEN 1 WHEN {near} RLIKE '{_words(AGAINST)}' THEN -1 ELSE 0 END,
        'long', least(length(x.m) div 8, 4))"""


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``cand``, the array of all candidate spans of a text with their votes."""
    slots = {k: (BASE[k], GUARD[k]) for k in KINDS} | {f"{k}_loose": (LOOSE[k], GUARD[f"{k}_loose"]) for k in KINDS if k != "card"}
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = df.selectExpr("doc_id", "text", *(_match_list(k, p, g) for k, (p, g) in slots.items()))
    df = df.selectExpr("*", *(_gap_list(k, p) for k, (p, _) in slots.items()))
    df = df.selectExpr("doc_id", "text", *(_place_list(k) for k in slots))
    lists = []
    for k in slots:
        kind, strict = k.removesuffix("_loose"), not k.endswith("_loose")
        enough = f"filter(p_{k}, x -> length({_digits('x.m')}) BETWEEN 13 AND 19)" if kind == "card" else f"p_{k}"
        lists.append(f"transform({enough}, x -> {_votes(kind, strict)})")
    return df.selectExpr("doc_id", f"concat({', '.join(lists)}) AS cand")


@dataclass
class SpanModel:
    """Per kind: bias, a weight per labeler and one for the length class."""

    weights: list[list[float]]
    reliability: dict[str, float]

    def probability(self, x: str) -> str:
        def line(w: list[float]) -> str:
            terms = [f"{w[0]!r}D"] + [f"{v!r}D * {x}.v_{name}" for v, name in zip(w[1:], LABELERS)] + [f"{w[-1]!r}D * {x}.long"]
            return " + ".join(terms)

        cases = " ".join(f"WHEN {i} THEN {line(w)}" for i, w in enumerate(self.weights))
        return f"1D / (1D + exp(-(CASE {x}.kind {cases} END)))"


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], float]], rounds: int = 60) -> tuple[list[float], dict[str, float]]:
    """Posterior of each (kind, votes, count) pattern and each labeler's reliability per kind.

    Votes are 1, 0 (no vote) or -1, independent given the truth; reliabilities start at 0.8 and
    counts are smoothed, so a kind without data keeps its prior.
    """
    right = {(k, j): 0.8 for k in range(len(KINDS)) for j in range(len(LABELERS))}
    prior = dict.fromkeys(range(len(KINDS)), 0.5)
    post = [0.5] * len(patterns)
    for _ in range(rounds):
        for i, (k, votes, _) in enumerate(patterns):
            odds = math.log(prior[k] / (1 - prior[k]))
            for j, v in enumerate(votes):
                odds += v * math.log(right[k, j] / (1 - right[k, j]))
            post[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
        for k in prior:
            own = [(p, votes, n) for p, (kind, votes, n) in zip(post, patterns) if kind == k]
            total = sum(n for *_, n in own)
            prior[k] = (sum(p * n for p, _, n in own) + 2) / (total + 4)
            for j in range(len(LABELERS)):
                agreed = sum(n * (p if votes[j] > 0 else 1 - p) for p, votes, n in own if votes[j])
                cast = sum(n for _, votes, n in own if votes[j])
                right[k, j] = min(0.99, max(0.55, (agreed + 8) / (cast + 10)))
    return post, {f"{KINDS[k]}.{LABELERS[j]}": r for (k, j), r in right.items()}


def train(rows: list[tuple[int, tuple[int, ...], int, float]], rounds: int = 400, rate: float = 0.5, ridge: float = 1e-3) -> SpanModel:
    """The span classifier: logistic regression on (kind, votes, length class, count) with the posteriors as soft labels."""
    merged: dict[tuple, float] = {}
    for k, votes, _, n in rows:
        merged[k, votes] = merged.get((k, votes), 0.0) + n
    keys = sorted(merged)
    post, reliability = expectation_maximisation([(*key, merged[key]) for key in keys])
    soft = dict(zip(keys, post))
    weights = []
    for kind in range(len(KINDS)):
        own = [(votes, long, n, soft[k, votes]) for k, votes, long, n in rows if k == kind]
        total = sum(n for _, _, n, _ in own) or 1.0
        w = [0.0] + [0.5] * len(LABELERS) + [0.0]
        for _ in range(rounds if own else 0):
            grad = [ridge * v for v in w]
            for votes, long, n, y in own:
                x = (1.0, *votes, float(long))
                err = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(a * b for a, b in zip(w, x)))))) - y
                for i, v in enumerate(x):
                    grad[i] += n / total * err * v
            w = [v - rate * g for v, g in zip(w, grad)]
        weights.append([round(v, 9) for v in w])
    return SpanModel(weights, reliability)


def fit(cand: DataFrame) -> SpanModel:
    """Only the counts of vote patterns, a few hundred rows whatever the corpus, come to the driver."""
    votes = [f"c.v_{name}" for name in LABELERS]
    counted = cand.select(F.explode("cand").alias("c")).groupBy("c.kind", *votes, "c.long").count()
    rows = sorted((r["kind"], tuple(r[f"v_{n}"] for n in LABELERS), r["long"], float(r["count"])) for r in counted.collect())
    return train(rows)


def _shown(spans: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({spans}, x -> concat(array({names})[x.kind], ':', x.s, ':', x.e)), ',')")


def find_personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans: base ones plus those the classifier accepts.

    One pass over the texts writes the candidates, which are few and slim; the vote patterns are counted and the
    candidates scored from there. No text is shuffled. Null and empty texts have no spans; repeated rows and null ids
    count like any others; extra columns are ignored; an empty table gives no rows.
    """
    cand = keep(candidates(docs), "pii")
    model = fit(cand)
    place = "x -> named_struct('s', x.s, 'kind', x.kind, 'e', x.e)"
    found = cand.selectExpr(
        "doc_id",
        f"array_sort(transform(filter(cand, x -> x.base), {place})) AS base",
        f"array_sort(array_distinct(transform(filter(cand, x -> x.base OR {model.probability('x')} >= {threshold}D), {place}))) AS spans",
    )
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_shown("base").cast("binary"), 256).alias("base_sha256"), _shown("spans").alias("spans"))
