"""Personal data and secrets by weak supervision, with DataFrame functions only.

Candidates are the matches of each kind's pattern, with their code-point offsets: a text's split by a
pattern and its matches alternate, so a window sum of their lengths gives every start. Texts are read once;
candidates are a written table. Five labelers vote for, against, or not at all: a strict form, a gazetteer
(known endings, prefixes, countries, placeholders), the words before, the characters round it, and the
variety of its characters. Expectation-maximisation over the counts of vote patterns (at most some ten
thousand rows, whatever the input) estimates each labeler's reliability for and against; the posteriors
train a logistic classifier over votes, kind, length and digits, which is applied as an expression.

Matches that fail their kind's check are never spans; those of the four base kinds that pass it always are.
The classifier decides all others:
masked e-mail addresses, phone numbers without country code, US social security numbers, bank accounts
(IBAN), street addresses, secrets (a key word and its value) and keys (long random strings; a digest of that
form can count as one). Of these, what
overlaps a base span, or one of a kind named before, isn't one.

Patterns are written so that no text makes them slow: possessive or bounded repeats, and starts only where
a run starts or the last match ended. Null or empty text has no span; a very long one is read like any
other. Rows of equal doc_id and text are one document: they get the same result each; a null doc_id is an
id of its own. An empty table gives no row. Only doc_id and text are read, so other columns may have any
names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinweave.llm.storage import Scratch

BASE = ("email", "ip", "card", "phone")
MORE = ("masked_email", "local_phone", "ssn", "iban", "address", "secret", "key")
KINDS = BASE + MORE
_PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++ ?(?:\[at\]|\(at\)|\{at\}) ?[a-z0-9-]++ ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[a-z]{2,12}(?![a-z0-9])",
    "local_phone": r"(?<![0-9+)(-])(?<!\+[0-9]{1,3}[ .-]{0,2})(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9.-])",
    "ssn": r"(?<![0-9.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "address": r"(?<![0-9A-Za-z.,-])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)(?![A-Za-z])",
    "secret": r"(?i)(?<![a-z])(?:token|secret|passw(?:or)?d|pwd|credential|(?:api|access|private|client|auth)[_-]?key)s?+[\"']?+[ \t]{0,2}(?:=>?|:=?)[ \t]{0,2}[\"']?+[^\s\"',;]{6,}+",
    "key": r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+",
}
_DIGITS = "[0-9]"
#: Top-level domains, countries of bank accounts, beginnings of keys of public services.
_TOP_LEVEL = ("com", "org", "net", "edu", "gov", "io", "co", "de", "fr", "es", "uk", "eu", "info")
_COUNTRIES = ("AT", "BE", "CH", "CZ", "DE", "DK", "ES", "FI", "FR", "GB", "GR", "HU", "IE", "IT", "LU", "NL", "NO", "PL", "PT", "SE")
_KEY_STARTS = r"(?:AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|sk_|sk-|pk_|xox[abp]-|AIza|eyJ|npm_|hf_)"
_PLACEHOLDERS = r"(?i)example|changeme|your|placeholder|xxxx|1234|null|none|true|false|[<>{}]"
_CUES = {
    "email": "mail|contact|write|address|reply|von|correo|courriel",
    "ip": r"\bip\b|host|server|address|login|from",
    "card": "card|visa|pay|karte|tarjeta|carte|number",
    "phone": "phone|call|tel|mobile|fax|dial|whatsapp",
    "masked_email": "mail|contact|write|address|reply",
    "local_phone": "phone|call|tel|mobile|fax|dial",
    "ssn": "ssn|social|security",
    "iban": "iban|account|konto|bank|cuenta|compte|transfer",
    "address": "address|live|lives|home|ship|deliver|visit|mail",
    "key": "token|key|secret|passw|pwd|bearer|auth|credential",
}
_DIGEST = r"commit|\bsha|hash|digest|checksum|md5|etag"
_AGAINST = r"version|release|isbn|build|section|figure|\bno\b|#|\$|€|" + _DIGEST
LABELERS = ("form", "gazetteer", "context", "edges", "variety")


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, mark, kind, pos, match, start, before, after of every match of every pattern."""
    parts, text, digits = [], F.col("text"), F.col("digits")
    needs = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+")), "masked_email": F.col("masked"), "secret": F.col("assigns")}  # without which a pattern can't match
    for kind in KINDS:
        none = F.array().cast("array<string>")
        may = needs.get(kind, digits)
        parts.append(F.struct(F.lit(kind).alias("kind"), F.when(may, F.split(text, _PATTERNS[kind], -1)).otherwise(none).alias("gaps"), F.when(may, F.regexp_extract_all(text, F.lit(_PATTERNS[kind]), F.lit(0))).otherwise(none).alias("found")))
    tests = {"digits": text.rlike(_DIGITS), "masked": text.rlike(r"(?i)[\[({]at[\])}]"), "assigns": F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))}
    seen = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("mark"), "text", *(v.alias(k) for k, v in tests.items()))
    seen = seen.where(digits | F.col("masked") | F.col("assigns") | F.contains("text", F.lit("@")))
    rows = seen.select("doc_id", "mark", F.explode(F.array(*parts)).alias("k")).where(F.size("k.found") > 0)
    rows = rows.select("doc_id", "mark", "k.kind", F.posexplode(F.arrays_zip(F.col("k.gaps").alias("gap"), F.col("k.found").alias("match"))).alias("pos", "at"))
    rows = rows.select("doc_id", "mark", "kind", "pos", F.col("at.match").alias("match"), F.length("at.gap").alias("gap"), F.right("at.gap", F.lit(32)).alias("before"), F.left("at.gap", F.lit(2)).alias("head"))
    rows = rows.dropDuplicates(["doc_id", "mark", "kind", "pos"])
    w = W.partitionBy("doc_id", "mark", "kind").orderBy("pos")
    past = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("match"), F.lit(0))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("start", past + F.col("gap")).withColumn("after", F.lead("head").over(w))
    return rows.where("match is not null").select("doc_id", "mark", "kind", "pos", "match", "start", (F.col("start") + F.length("match")).alias("end"), "before", "after")


def _account_fits(match: Column) -> Column:
    """Whether the check digits of a bank account hold: the number, its first four characters last, is 1 modulo 97."""
    plain = F.regexp_replace(match, " ", "")
    moved = F.split(F.concat(F.substring(plain, 5, 40), F.left(plain, F.lit(4))), "")
    code = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.filter(moved, lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97) == 1


def _valid(kind: Column, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    small = F.forall(F.split(match, r"\."), lambda x: x.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", small)
        .when(kind == "card", F.length(digits).between(14, 19) & F.call_function("luhn_check", digits))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .when(kind == "iban", _account_fits(match))
        .otherwise(F.lit(True))
    )


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, F.lit(1)).when(no, F.lit(-1)).otherwise(F.lit(0))


def _labelled(matches: DataFrame) -> DataFrame:
    kind, match, digits = F.col("kind"), F.col("match"), F.regexp_replace("match", "[^0-9]", "")
    valid = _valid(kind, match)
    last = F.lower(F.regexp_extract(match, r"([A-Za-z]+)[^A-Za-z]*$", 1))
    mail, hidden = kind.isin("email", "masked_email"), kind.isin("secret", "key")
    value = F.when(kind == "secret", F.regexp_extract(match, r"([^\s\"',;:=>]+)$", 1)).otherwise(match)  # of a secret, what follows the key word
    mixed = value.rlike("[a-z]") & value.rlike("[A-Z]") & value.rlike("[0-9].*[0-9].*[0-9]")
    hexed = value.rlike("^(?:[0-9a-f]{20,}|[0-9A-F]{20,})$")
    cue = (kind == "secret") & match.rlike(r"[=:]\s*[\"']|[=:]\s*\S*[0-9]")
    for name, words in _CUES.items():
        cue = cue | ((kind == name) & F.lower("before").rlike(words))
    form = (
        F.when(kind == "key", _vote(mixed, ~hexed & ~mixed))  # digits of a number system may be a digest
        .when(kind == "secret", _vote((F.length(value) >= 8) & value.rlike("[0-9]"), ~value.rlike("[0-9]") & value.rlike("^[a-z]+$|^[A-Z]?[a-z]+$")))
        .otherwise(_vote(valid & ~((kind == "email") & match.rlike(r"^[.-]|\.\.|-$")), ~valid))
    )
    known = (
        F.when(mail, _vote(last.isin(*_TOP_LEVEL), F.length(last) < 2))
        .when(kind == "ip", _vote(~match.rlike(r"^(?:0|127|255)\."), match.rlike(r"^0\.|^(?:1|2|3)\.[0-9]\.[0-9]\.[0-9]$")))
        .when(kind == "card", _vote(digits.rlike("^(?:4|5[1-5]|2[2-7]|3[47]|6)"), digits.rlike("^[089]")))
        .when(kind == "phone", _vote(digits.rlike("^(?:1|2[07]|3|4|5|6|7|8|9)"), digits.rlike("^0")))
        .when(kind == "local_phone", _vote(digits.rlike("^[2-9][0-9]{2}[2-9]"), digits.rlike("^[01]")))
        .when(kind == "ssn", _vote(~digits.rlike("^(?:000|666|9)"), digits.rlike("^(?:000|666|9)")))
        .when(kind == "iban", _vote(F.left(match, F.lit(2)).isin(*_COUNTRIES), F.lit(False)))
        .when(hidden, _vote(value.rlike("^" + _KEY_STARTS), value.rlike(_PLACEHOLDERS) & ~hexed | value.rlike("^[A-Za-z]+(?:[-_][A-Za-z0-9]+)+$") | ((kind == "key") & F.lower("before").rlike(_DIGEST))))
        .otherwise(F.lit(0))
    )
    word = "[A-Za-z0-9]"
    touched = F.right("before", F.lit(1)).rlike(word) | F.coalesce(F.left("after", F.lit(1)), F.lit("")).rlike(word)
    varied = F.size(F.array_distinct(F.split(F.when(mail | hidden | (kind == "address"), value).otherwise(digits), "")))
    return matches.withColumns(
        {
            "valid": valid,
            "form": form,
            "gazetteer": known,
            "context": _vote(cue, F.lower("before").rlike(_AGAINST)),
            "edges": _vote(~touched, touched),
            "variety": F.when(hidden, _vote(varied >= 9, varied <= 5)).otherwise(_vote(varied >= 4, varied <= 2)),
            "size": F.least(F.floor(F.length("match") / 5), F.lit(7)).cast("int"),
            "share": F.least(F.floor(F.length(digits) * 4 / F.length("match")), F.lit(3)).cast("int"),
        }
    )


def reliabilities(votes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns: P(vote | true) as [class, labeler, vote + 1], and posteriors.

    ``votes`` is patterns by labelers; ``counts`` how often each pattern is there. It starts from the votes' mean.
    """
    p = 1 / (1 + np.exp(-votes.sum(axis=1)))
    table = np.zeros((2, votes.shape[1], 3))
    for _ in range(rounds):
        prior = float(np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99))
        for c, weight in ((0, counts * (1 - p)), (1, counts * p)):
            for v in (-1, 0, 1):
                table[c, :, v + 1] = ((votes == v) * weight[:, None]).sum(axis=0) + (2.0 if v == (1 if c else -1) else 1.0)
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log(table)
        at = np.arange(votes.shape[1])
        score = np.array([(logs[1, at, v + 1] - logs[0, at, v + 1]).sum() for v in votes]) + math.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - p).max() < 1e-9:
            break
        p = new
    return table, p


@dataclass
class SpanClassifier:
    """Weights of a logistic regression over the discrete figures of a span."""

    weights: dict[tuple[str, object], float] = field(default_factory=dict)
    bias: float = -1.0

    @classmethod
    def fit(cls, rows: list[dict]) -> SpanClassifier:
        """From counted rows with kind, the votes, size, share and n."""
        if not rows:
            return cls()
        votes = np.array([[r[x] for x in LABELERS] for r in rows])
        counts = np.array([r["n"] for r in rows], dtype=np.float64)
        _, soft = reliabilities(votes, counts)
        names = sorted({(x, r[x]) for r in rows for x in ("kind", *LABELERS, "size", "share")}, key=str)
        place = {x: i for i, x in enumerate(names)}
        z = np.zeros((len(rows), len(names) + 1))
        z[:, -1] = 1
        for i, r in enumerate(rows):
            for x in ("kind", *LABELERS, "size", "share"):
                z[i, place[x, r[x]]] = 1
        w = np.zeros(z.shape[1])
        counts = counts / counts.sum() * min(counts.sum(), 1e5)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            h = (z * (counts * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z + np.eye(len(w))
            step = np.linalg.solve(h, z.T @ (counts * (soft - p)) - w)
            w += step
            if np.abs(step).max() < 1e-8:
                break
        return cls({x: float(w[i]) for x, i in place.items()}, float(w[-1]))

    def expression(self) -> Column:
        z = F.lit(self.bias)
        for x in ("kind", *LABELERS, "size", "share"):
            mine = F.lit(0.0)
            for (name, value), weight in self.weights.items():
                if name == x:
                    mine = F.when(F.col(x) == F.lit(value), F.lit(weight)).otherwise(mine)
            z = z + mine
        return 1 / (1 + F.exp(-z))


def find_pii(spark: SparkSession, docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """One row for each span: doc_id, mark (hash of the text), kind, start, end, match, score, base."""
    scratch = scratch or Scratch(spark, "pii")
    rows = scratch.keep(_labelled(_matches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))), "candidates")
    counted = rows.groupBy("kind", *LABELERS, "size", "share").agg(F.count("*").alias("n")).collect()  # at most 11 * 3**5 * 32 rows
    model = SpanClassifier.fit(sorted((r.asDict() for r in counted), key=str))
    rows = rows.withColumn("score", model.expression()).withColumn("base", F.col("kind").isin(*BASE))
    return rows.where(F.col("valid") & (F.col("base") | (F.col("score") >= 0.5))).select("doc_id", "mark", "kind", "start", "end", "match", "score", "base")


def pii_of_documents(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each document: the base spans' counts and digest, all spans, and how many those are."""
    rank = F.coalesce(*(F.when(F.col("kind") == k, F.lit(i)) for i, k in enumerate(KINDS)))
    spans = find_pii(spark, docs).withColumn("rank", rank)
    w = W.partitionBy("doc_id", "mark").orderBy("start", "rank", "end")
    past, next_ = w.rowsBetween(W.unboundedPreceding, -1), w.rowsBetween(1, W.unboundedFollowing)
    hidden = F.lit(False)  # by a span of a kind named before
    for i in range(len(BASE), len(KINDS)):
        before = F.col("rank") < i
        over = (F.max(F.when(before, F.col("end"))).over(past) > F.col("start")) | (F.min(F.when(before, F.col("start"))).over(next_) < F.col("end"))
        hidden = F.when(F.col("rank") == i, F.coalesce(over, F.lit(False))).otherwise(hidden)
    spans = spans.withColumn("hidden", hidden).where(~F.col("hidden"))
    spans = spans.withColumn("s", F.struct("start", "rank", "end", F.concat_ws(":", "kind", "start", "end").alias("said"), "base"))
    each = spans.groupBy("doc_id", "mark").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{k}") for k in BASE), F.sort_array(F.collect_list("s")).alias("all"))
    joined = lambda x: F.array_join(F.transform(x, lambda s: s["said"]), ",")
    each = each.select("doc_id", "mark", *(f"n_{k}" for k in BASE), joined(F.filter("all", lambda s: s["base"])).alias("base"), joined(F.col("all")).alias("spans"), F.size("all").alias("n_spans"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"))
    each = each.withColumnsRenamed({"doc_id": "d", "mark": "m"})
    out = every.join(each, every["doc_id"].eqNullSafe(each["d"]) & (every["mark"] == each["m"]), "left")
    empty, counts = F.lit(""), [*(f"n_{k}" for k in BASE), "n_spans"]
    return out.select("doc_id", *(F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in counts), F.sha2(F.coalesce("base", empty), 256).alias("base_sha256"), F.coalesce("spans", empty).alias("spans"))
