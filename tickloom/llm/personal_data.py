"""Personal data by weak supervision.

Strict patterns give the base spans, which always stay; loose patterns give more candidates.
Labelers vote on every candidate: pattern, check sum or range, gazetteer, words before it that speak
for or against it, and the characters around it. Expectation-maximisation over the counts of all
vote combinations, by kind, estimates how reliable each labeler is; its posteriors train a logistic
span classifier, which decides on the candidates beyond the base.

Defined results: null and empty texts have no spans; a text without further candidates has its base
spans alone; repeated rows are scanned one by one; without any candidate no model is fitted.
Vote combinations are at most kinds x 3**labelers, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.store import bounded_sample, written
from tickloom.session import ship_package

KINDS = ("email", "ip", "card", "phone")
#: Candidates that the span classifier is fitted on at most.
SAMPLE = 20_000
HASHED = 64

# Name endings and cue words in the languages of the corpus.
ENDINGS = frozenset("com org net edu gov mil int info biz io ai co uk us de fr es it nl eu ch at be pl pt se no dk fi ie ca au jp in br mx".split())
FOR = {
    "email": ("email", "e-mail", "mail", "mailto", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "ping", "adresse"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "cell", "fax", "telefon", "handy", "telefono", "appelez"),
}
AGAINST = ("version", "isbn", "issn", "doi", "order", "invoice", "build", "release", "page", "section", "sha", "md5", "uuid", "serial")

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE_EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}[\x20]?(?:\(at\)|\[at\])[\x20]?[A-Za-z0-9-]{1,63}(?:[\x20]?(?:\.|\(dot\)|\[dot\])[\x20]?[A-Za-z0-9-]{1,63})+")
LOOSE_PHONE = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\)[\x20]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
LOOSE_IP = re.compile(r"(?<![0-9A-Fa-f:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Fa-f:])")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from each @: the run of local characters before it, not before the last match."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Strict spans of all kinds, by kind and place."""
    out = [("email", *s) for s in base_emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in CHAIN.finditer(text):
        if m[0].count(".") >= 3:
            runs = list(re.finditer("[0-9]+", m[0]))
            for i in range(0, len(runs) - 3, 4):
                if all(len(r[0].lstrip("0")) <= 3 and int(r[0].lstrip("0") or 0) <= 255 for r in runs[i:i + 4]):
                    out.append(("ip", m.start() + runs[i].start(), m.start() + runs[i + 3].end()))
    for m in CARD.finditer(text):
        if 13 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text)] if "(at)" in text or "[at]" in text else []
    if DIGIT.search(text):
        out += [("phone", m.start(), m.end()) for m in LOOSE_PHONE.finditer(text)]
        out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits_of(m[0])) <= 19]
        if ":" in text:
            out += [("ip", m.start(), m.end()) for m in LOOSE_IP.finditer(text)]
    return out


def votes_of(text: str, kind: str, start: int, end: int, strict: bool) -> tuple[list[int], list[str]]:
    """Votes (-1, 0, 1) of the labelers, and the words before the span."""
    span, digits = text[start:end], digits_of(text[start:end])
    before = re.findall(r"[^\W_]+(?:-[^\W_]+)?", text[max(0, start - 48):start].lower())[-4:]
    if kind == "email":
        tail = re.split(r"[^A-Za-z]+", span.strip())[-1].lower()
        valid, listed = 1 if len(tail) >= 2 else -1, 1 if tail in ENDINGS else -1
    elif kind == "ip":
        valid, listed = 1 if strict or ":" in span else -1, -1 if span.split(".")[0] in ("0", "1", "2") else 0
    elif kind == "card":
        valid, listed = 1 if luhn(digits) else -1, 1 if digits[0] in "3456" and len(set(digits)) > 2 else -1
    else:
        valid, listed = 1 if 9 <= len(digits) <= 15 else -1, 1 if span[0] == "+" and span[1] != "0" or digits[0] in "23456789" else -1
    cue = 1 if any(w in FOR[kind] for w in before) else 0
    doubt = -1 if any(w in AGAINST for w in before) else 0
    around = text[start - 1:start] + text[end:end + 1]
    return [1 if strict else -1, valid, listed, cue, doubt, -1 if any(c.isalnum() for c in around) else 1], before


LABELERS = 6
CANDIDATE = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()),
                       ("code", pa.int32()), ("context", pa.list_(pa.int32()))])


def _code(votes: list[int]) -> int:
    return sum((v + 1) * 3**i for i, v in enumerate(votes))


def _votes(codes: np.ndarray) -> np.ndarray:
    return (codes[:, None] // 3 ** np.arange(LABELERS)) % 3 - 1


def candidates_of(text: str) -> list[dict]:
    base = base_spans(text)
    taken = set(base)
    found = []
    for kind, start, end in [*base, *(s for s in loose_spans(text) if s not in taken)]:
        strict = (kind, start, end) in taken
        votes, before = votes_of(text, kind, start, end, strict)
        found.append({"kind": KINDS.index(kind), "start": start, "end": end, "base": strict, "code": _code(votes),
                      "context": sorted({xxhash.xxh32_intdigest(w) % HASHED for w in before})})
    return found


def reliabilities(kind: np.ndarray, codes: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Posterior of each (kind, vote combination) by expectation-maximisation over their counts."""
    votes, out = _votes(codes) + 1, np.zeros(len(codes))
    for k in np.unique(kind):
        at = kind == k
        v, n = votes[at], counts[at].astype(float)
        p = 1 / (1 + np.exp(-(v - 1).sum(axis=1)))  # the majority, softly
        for _ in range(rounds):
            prior = np.clip((p * n).sum() / n.sum(), 0.01, 0.99)
            logit = np.full(len(v), np.log(prior / (1 - prior)))
            for j in range(LABELERS):
                good, bad = (np.bincount(v[:, j], w * n, 3) + 0.5 for w in (p, 1 - p))
                logit += np.log(good / good.sum())[v[:, j]] - np.log(bad / bad.sum())[v[:, j]]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        out[at] = p
    return out


def _inputs(rows: list[tuple[int, int, int, list[int]]]) -> np.ndarray:
    """Design matrix of (kind, length, vote code, context places)."""
    x = np.zeros((len(rows), 2 + len(KINDS) + LABELERS * 2 + HASHED))
    for i, (kind, length, code, context) in enumerate(rows):
        x[i, 0], x[i, 1], x[i, 2 + kind] = 1, min(length, 64) / 64, 1
        x[i, [2 + len(KINDS) + LABELERS * 2 + c for c in context]] = 1
    if rows:
        v = _votes(np.array([r[2] for r in rows]))
        x[:, 2 + len(KINDS):2 + len(KINDS) + LABELERS] = v == 1
        x[:, 2 + len(KINDS) + LABELERS:2 + len(KINDS) + 2 * LABELERS] = v == -1
    return x


def _train(x: np.ndarray, y: np.ndarray, rounds: int = 300, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    step = 4 / max((x**2).sum(axis=1).mean(), 1)
    for _ in range(rounds):
        w -= step * (x.T @ (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) - y) / len(y) + ridge * w)
    return w


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the candidates of every document, with their votes."""
    def run(batches):
        for batch in batches:
            found = [candidates_of(t or "") for t in batch.column("text").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "found": pa.array(found, pa.list_(CANDIDATE))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, found array<struct<kind:int,start:int,end:int,base:boolean,code:int,context:array<int>>>")


def fit(found: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    spans = found.select("doc_id", F.explode("found").alias("s")).select("doc_id", "s.*")
    seen = spans.groupBy("kind", "code").count().collect()  # at most kinds x 3**labelers rows
    if not seen:
        return None
    kind, codes, counts = (np.array([r[i] for r in seen]) for i in range(3))
    posterior = dict(zip(zip(kind.tolist(), codes.tolist()), reliabilities(kind, codes, counts)))
    # Keyed on id and place, so that no document with very many spans brings all of them.
    rows = bounded_sample(spans.withColumn("_key", F.xxhash64("doc_id", "start", "kind")), "_key", sample)
    rows.sort(key=lambda r: (r["kind"], r["code"], r["end"] - r["start"], r["context"]))
    x = _inputs([(r["kind"], r["end"] - r["start"], r["code"], r["context"]) for r in rows])
    return _train(x, np.array([posterior[r["kind"], r["code"]] for r in rows])) if rows else None


def _chosen(found: list[dict], weights: np.ndarray | None) -> list[tuple[int, int, int, bool]]:
    """Base spans, and other candidates that the classifier takes where nothing taken overlaps them."""
    out = [(s["kind"], s["start"], s["end"], True) for s in found if s["base"]]
    more = [s for s in found if not s["base"]]
    if more and weights is not None:
        p = _inputs([(s["kind"], s["end"] - s["start"], s["code"], s["context"]) for s in more]) @ weights
        for s, z in sorted(zip(more, p), key=lambda x: (x[0]["start"], x[0]["end"])):
            if z > 0 and not any(a < s["end"] and s["start"] < b for _, a, b, _ in out):
                out.append((s["kind"], s["start"], s["end"], False))
    return sorted(out)


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, base) of every document, by kind and place."""
    ship_package(docs.sparkSession)
    found = written(scanned(docs), "personal-data")
    weights = fit(found)

    def run(batches):
        for batch in batches:
            rows = [[dict(kind=KINDS[k], start=a, end=b, base=s) for k, a, b, s in _chosen(f or [], weights)]
                    for f in batch.column("found").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "spans": pa.array(rows, pa.list_(pa.struct(
                [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return found.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int,base:boolean>>")


def span_table(docs: DataFrame) -> DataFrame:
    """Base counts and digest, and all spans as text. Columns are built from ``spans``."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    return spans(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", text), ",").alias("spans"))


def digest_of(base: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
