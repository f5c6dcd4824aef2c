"""Personal data by weak supervision.

Base patterns give spans that always stand. Wider patterns propose more: each candidate, base ones
included, gets votes from regex, checksum, gazetteer, context, boundary and backing labelers (for, against
or none). Dawid-Skene expectation-maximisation over the counts of all vote patterns in the corpus estimates
what each labeler's votes are worth, and gives each candidate a soft label. A logistic span classifier is
trained on these labels; it doesn't see the votes but what the labelers don't look at: the span's shape
(lengths, digits, capitals, separators) and the words beside it. Its verdict decides on what is added.

Vote patterns are few (a fixed number), so the counts that reach the driver have a fixed bound, while they
cover every candidate of every document; the classifier is fitted on a bounded sample of candidates.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vantarow.llm.common import keep, lean, texts_of

KINDS = ("email", "ip", "card", "phone", "address", "birth", "iban", "name", "ssn")
LABELERS = ("form", "checksum", "gazetteer", "context", "boundary", "backing")
_SHAPE = (len(KINDS), *(3,) * len(LABELERS))
#: Weights of the span classifier: features are hashed to so many.
WIDTH = 1 << 12
#: The most candidates that the span classifier is fitted on, chosen by hash; votes are counted over all.
MAX_SAMPLE = 20_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

#: Wider patterns, each with the kind it proposes and byte strings of which a text must hold one.
WIDER = (
    ("email", re.compile(r"(?<![\w.])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]| dot |\.) ?[A-Za-z]{2,24}){1,4}(?![\w])"), (b"(at)", b"[at]", b" at ")),
    ("phone", re.compile(r"(?<![\w+.-])\(?[2-9][0-9]{2}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-]|\.[0-9])"), None),
    ("ssn", re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])"), None),
    ("iban", re.compile(r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), None),
    ("birth", re.compile(r"(?<![\w.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4})(?![\w-])"), None),
    ("address", re.compile(r"(?<!\w)[0-9]{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+){0,2} (?:Street|Avenue|Road|Lane|Drive|Boulevard|Square|Court|St|Ave|Rd|Ln|Dr|Blvd)\b"), None),
    ("name", re.compile(r"(?:(?<=[Nn]ame is )|(?<=\bMr\. )|(?<=\bMs\. )|(?<=\bDr\. )|(?<=\bMrs\. )|(?<=\bDear ))[A-Z][a-z]{1,20}(?: [A-Z][a-z]{1,20}){0,2}"), (b"ame is ", b"Mr. ", b"Ms. ", b"Dr. ", b"Mrs. ", b"Dear ")),
)

#: Words that name a kind of personal data just before it, and words that name something else.
CUES = {
    "email": ("email", "e-mail", "mail", "write", "contact"),
    "ip": ("ip", "address", "host", "login", "from"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "cell", "fax", "contact", "reach", "text"),
    "address": ("address", "live", "lives", "living", "reside", "resides", "ship", "home"),
    "birth": ("born", "birth", "birthday", "dob"),
    "iban": ("iban", "account", "bank", "transfer"),
    "name": ("name", "mr", "mrs", "ms", "dr", "dear"),
    "ssn": ("ssn", "social", "security", "insurance"),
}
ANTI_CUES = ("version", "figure", "section", "isbn", "order", "page", "chapter", "release", "model", "serial", "build", "part", "table")
#: Common given names of several languages, and endings of host names.
GIVEN_NAMES = frozenset((
    "Adam", "Agnes", "Ahmed", "Aisha", "Albert", "Alejandro", "Alex", "Alexander", "Alice", "Amanda", "Amir", "Amy", "Ana", "Andrea", "Andrew", "Angela", "Anna", "Anne", "Anthony", "Antoine",
    "Antonio", "Arthur", "Barbara", "Beatriz", "Ben", "Benjamin", "Brian", "Camille", "Carla", "Carlos", "Carmen", "Caroline", "Catherine", "Charles", "Charlotte", "Chen", "Chloe", "Chris", "Christian", "Claire",
    "Clara", "Daniel", "David", "Deborah", "Denis", "Diana", "Diego", "Dieter", "Dorothy", "Edward", "Elena", "Elizabeth", "Emily", "Emma", "Eric", "Ernst", "Eva", "Fatima", "Felix", "Fernando",
    "Florian", "Francesca", "Francisco", "Frank", "Franz", "Gabriel", "George", "Gerhard", "Giovanni", "Giulia", "Grace", "Hannah", "Hans", "Heinrich", "Helen", "Helga", "Henry", "Hugo", "Ibrahim", "Ingrid",
    "Irina", "Isabel", "Ivan", "Jack", "Jacob", "Jacques", "James", "Jan", "Jane", "Javier", "Jean", "Jennifer", "Jessica", "Joan", "Johannes", "John", "Jonas", "Jorge", "Jose", "Joseph",
    "Juan", "Julia", "Julie", "Karen", "Karl", "Katharina", "Kevin", "Klaus", "Laura", "Lea", "Leon", "Lin", "Linda", "Lisa", "Louis", "Louise", "Lucas", "Lucia", "Luis", "Lukas",
    "Manuel", "Marco", "Margaret", "Maria", "Marie", "Mario", "Mark", "Marta", "Martin", "Mary", "Matthew", "Max", "Mehmet", "Mei", "Michael", "Miguel", "Mohammed", "Monika", "Nancy", "Natalia",
    "Nicolas", "Nina", "Olga", "Oliver", "Omar", "Pablo", "Patricia", "Paul", "Pedro", "Peter", "Philipp", "Pierre", "Rachel", "Raj", "Richard", "Robert", "Rosa", "Ruth", "Samuel", "Sandra",
    "Sara", "Sarah", "Sergei", "Simon", "Sofia", "Sophie", "Stefan", "Susan", "Thomas", "Ursula", "Victor", "Walter", "Wei", "William", "Wolfgang", "Yuki", "Yusuf", "Zoe",
))
ENDINGS = frozenset((
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "io", "ai", "app", "dev", "co", "me", "tv", "eu", "us", "uk", "ca", "au", "nz", "ie", "de", "at", "ch", "fr", "be",
    "nl", "lu", "es", "pt", "it", "gr", "pl", "cz", "sk", "hu", "ro", "bg", "se", "no", "dk", "fi", "is", "ee", "lv", "lt", "ru", "ua", "tr", "il", "ae", "in", "cn", "jp", "kr", "sg", "br", "mx", "ar", "cl", "za",
))


def _luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each @ so that long runs without one cost nothing."""
    out, at, last = [], text.find("@"), 0
    while at >= 0:
        left = _LOCAL.match(text[last:at][::-1])
        right = left and _DOMAIN.match(text, at + 1)
        last = at + 1
        if right:
            out.append((at - left.end(), right.end()))
            last = right.end()
        at = text.find("@", last)
    return out


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of kind, kind, end) of base matches, code points, sorted."""
    out = [(a, 0, "email", b) for a, b in emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m.group().split("."))):
                out.append((m.start(), 1, "ip", m.end()))
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, "card", m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, "phone", m.end()))
    return sorted(out)


def _votes(text: str, kind: str, start: int, end: int, base: bool) -> int:
    """Code of kind and votes (0 none, 1 for, 2 against by labeler). Backing speaks against what no other evidence is for."""
    body = text[start:end]
    before = re.findall(r"[a-z-]+", text[max(0, start - 48) : start].lower())[-6:]
    form = 1 if base else 0
    checksum = 0
    if kind == "card":
        checksum = 1
    elif kind == "iban":
        checksum = 1 if _iban(body) else 2
    elif kind == "ssn":
        checksum = 2 if body[:3] in ("000", "666") or body[0] == "9" or body[4:6] == "00" or body[7:] == "0000" else 1
    elif kind == "birth":
        parts = [int(x) for x in re.findall(r"[0-9]+", body)]
        year = max(parts)
        checksum = 1 if 1900 <= year <= 2025 and sorted(parts)[0] >= 1 and sorted(parts)[1] <= 31 else 2
    elif kind == "phone" and not base:
        checksum = 2 if len(set(re.sub(r"\D", "", body))) < 3 else 1
    gazetteer = 0
    if kind == "email":
        gazetteer = 1 if re.split(r"\W|dot", body.lower())[-1] in ENDINGS else 2
    elif kind == "name":
        gazetteer = 1 if body.split(" ")[0] in GIVEN_NAMES else 0
    elif kind == "address":
        gazetteer = 1
    context = 1 if any(w in CUES[kind] for w in before) else 2 if any(w in ANTI_CUES for w in before) else 0
    beside = text[start - 1 : start] + text[end : end + 1]
    boundary = 2 if any(c.isalnum() or c in "_=/" for c in beside) else 0
    backing = 0 if form or 1 in (checksum, gazetteer, context) else 2
    code = KINDS.index(kind)
    for vote in (form, checksum, gazetteer, context, boundary, backing):
        code = code * 3 + vote
    return code


def _class(ch: str) -> str:
    return "" if not ch else "0" if ch.isdigit() else "A" if ch.isupper() else "a" if ch.isalpha() else " " if ch.isspace() else ch


def _features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed features of a span's shape and its neighbours, each with the kind."""
    body = text[start:end]
    digits = [c for c in body if c.isdigit()]
    before = re.findall(r"\w+", text[max(0, start - 40) : start].lower())[-2:]
    after = re.findall(r"\w+", text[end : end + 24].lower())[:1]
    found = {
        "kind": "", "length": min(len(body) // 4, 9), "digits": 4 * len(digits) // max(1, len(body)), "different": min(len(set(digits)), 6), "capitals": min(sum(c.isupper() for c in body), 4),
        "marks": "".join(sorted({c for c in body if not c.isalnum()}))[:6], "first": _class(body[:1]), "last": _class(body[-1:]), "left": _class(text[start - 1 : start]), "right": _class(text[end : end + 1]),
        "before": before[-1] if before else "", "second": before[0] if len(before) > 1 else "", "after": after[0] if after else "", "opens": not text[:start].strip() if start < 8 else text[start - 1] == "\n",
    }
    return [zlib.crc32(f"{kind}|{k}|{v}".encode()) % WIDTH for k, v in found.items()]


Span = tuple[int, int, str, int, int, list[int]]


def find(text: str, raw: bytes | None = None) -> tuple[list, list[Span]]:
    """Base spans, and candidates with the codes of their votes and features; one beside base never overlaps one, nor a longer one."""
    raw = text.encode() if raw is None else raw
    base = base_spans(text)
    found = [(*x, _votes(text, x[2], x[0], x[3], True), _features(text, x[2], x[0], x[3])) for x in base]
    taken: list[tuple[int, int]] = []
    for a, _, _, b in base:
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    wider = []
    some_digit = _DIGITS.search(text)
    for kind, pattern, needs in WIDER:
        if any(n in raw for n in needs) if needs else some_digit:
            wider += [(m.start(), KINDS.index(kind), kind, m.end()) for m in pattern.finditer(text)]
    for x in sorted(wider, key=lambda x: (x[0] - x[3], x)):
        # what is taken is disjoint and sorted: only the two neighbours can overlap
        at = bisect_left(taken, (x[0], x[3]))
        if (at == 0 or taken[at - 1][1] <= x[0]) and (at == len(taken) or taken[at][0] >= x[3]):
            insort(taken, (x[0], x[3]))
            found.append((*x, _votes(text, x[2], x[0], x[3], False), _features(text, x[2], x[0], x[3])))
    return base, found


def _written(spans: list) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)


_NEEDS = tuple({n for _, _, needs in WIDER if needs for n in needs})


def _rows(column: pa.Array) -> Iterator[tuple[str | None, bytes]]:
    """The text of every row that can hold a span at all, else None; and its bytes."""
    data, offs = texts_of(column)
    whole = data.tobytes()
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(((data >= 48) & (data <= 57)) | (data == 64), out=marks[1:])
    some = marks[offs[1:]] > marks[offs[:-1]]
    for i, maybe in enumerate(some):
        raw = whole[offs[i] : offs[i + 1]]
        yield (raw.decode() if maybe or any(n in raw for n in _NEEDS) else None), raw


_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,code:int,features:array<int>>>"
_FOUND = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("code", pa.int32()), ("features", pa.list_(pa.int32()))]))


@lean
def _detect(batches: Iterator[pa.RecordBatch], at: str, to: str) -> Iterator[pa.RecordBatch]:
    """Adds the candidates of the text in column ``at`` as column ``to``."""
    for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
        spans = []
        for text, raw in _rows(batch.column(batch.schema.get_field_index(at))):
            found = find(text, raw)[1] if text is not None else []
            spans.append([dict(zip(("start", "rank", "kind", "end", "code", "features"), x)) for x in found])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _FOUND)], names=[*batch.schema.names, to])


def _parts() -> tuple[np.ndarray, np.ndarray]:
    """Kind and votes of every code."""
    parts = np.array(np.unravel_index(np.arange(int(np.prod(_SHAPE))), _SHAPE)).T
    return parts[:, 0], parts[:, 1:]


def soft_labels(counts: dict[int, int], rounds: int = 60) -> np.ndarray:
    """Probability that a candidate is personal data, for every code, from counts of codes.

    EM over votes given the unknown truth (Dawid-Skene with abstention; one prior by kind, smoothed).
    """
    kind, votes = _parts()
    weight = np.zeros(len(kind))
    for code, n in counts.items():
        weight[code] = n
    # few candidates say little: the labelers' votes are taken to be mostly right at first
    prior = np.full(len(KINDS), 0.5)
    given = np.empty((2, len(LABELERS), 3))
    given[1] = (0.35, 0.6, 0.05)
    given[0] = (0.55, 0.05, 0.4)
    start, strength = given.copy(), 50.0
    for _ in range(rounds):
        like = np.stack([np.log(given[y][np.arange(len(LABELERS)), votes]).sum(axis=1) for y in (0, 1)])
        odds = like[1] - like[0] + np.log(prior[kind] / (1 - prior[kind]))
        p = 1 / (1 + np.exp(-odds))
        for y, q in ((1, p), (0, 1 - p)):
            for j in range(len(LABELERS)):
                seen = np.bincount(votes[:, j], weights=weight * q, minlength=3) + strength * start[y, j]
                given[y, j] = seen / seen.sum()
        hits = np.bincount(kind, weights=weight * p, minlength=len(KINDS))
        prior = np.clip((hits + 10) / (np.bincount(kind, weights=weight, minlength=len(KINDS)) + 20), 0.02, 0.98)
    return p


def span_classifier(features: np.ndarray, label: np.ndarray, steps: int = 600, rate: float = 0.5, shrink: float = 1e-5) -> np.ndarray:
    """Weights of a logistic model of soft labels over rows of hashed features (full-batch AdaGrad); zeros without rows."""
    w, grown = np.zeros(WIDTH), np.full(WIDTH, 1e-8)
    if not len(features):
        return w
    for _ in range(steps):
        off = 1 / (1 + np.exp(-np.clip(w[features].sum(axis=1), -30, 30))) - label
        grad = np.bincount(features.ravel(), weights=np.repeat(off, features.shape[1]), minlength=WIDTH) / len(features) + shrink * w
        grown += grad * grad
        w -= rate * grad / np.sqrt(grown)
    return w


def fitted(found: DataFrame, key: list[str], sample: int = MAX_SAMPLE) -> np.ndarray:
    """The span classifier's weights; ``found``: arrays of candidates in column ``found``.

    At most one row per code of votes, and ``sample`` candidates chosen by hash, are collected.
    """
    each = found.select(*key, F.explode("found").alias("x"))
    counts = {int(r["code"]): int(r["n"]) for r in each.groupBy(F.col("x.code").alias("code")).agg(F.count(F.lit(1)).alias("n")).collect()}
    p = soft_labels(counts)
    share = int(min(1.0, 1.2 * sample / max(1, sum(counts.values()))) * (1 << 31))
    draw = F.pmod(F.xxhash64(*key, "x.start", "x.kind"), F.lit(1 << 31))
    rows = each.select(draw.alias("draw"), F.col("x.code").alias("code"), F.col("x.features").alias("features")).where(F.col("draw") <= share).orderBy("draw", "code", "features").limit(sample).collect()
    return span_classifier(np.array([r["features"] for r in rows], np.int64), p[[int(r["code"]) for r in rows]] if rows else np.empty(0))


def _stands(found: list[dict], weights: np.ndarray, least: float) -> list[tuple[int, int, str, int]]:
    """Base spans and those that the classifier accepts: (start, rank, kind, end), sorted."""
    limit = np.log(least / (1 - least))
    form = 3 ** (len(LABELERS) - 1)
    return sorted((x["start"], x["rank"], x["kind"], x["end"]) for x in found if x["code"] // form % 3 == 1 or weights[x["features"]].sum() >= limit)


@lean
def _report(batches: Iterator[pa.RecordBatch], weights, least: float) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, 4096) for whole in batches for k in range(0, whole.num_rows, 4096)):
        form = 3 ** (len(LABELERS) - 1)
        out: dict[str, list] = {k: [] for k in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")}
        for found in batch.column(1).to_pylist():
            base = sorted((x["start"], x["rank"], x["kind"], x["end"]) for x in found if x["code"] // form % 3 == 1)
            spans = _stands(found, weights.value, least) if found else []
            for k in range(4):
                out[f"n_{KINDS[k]}"].append(sum(x[1] == k for x in base))
            out["base_sha256"].append(hashlib.sha256(_written(base).encode()).hexdigest())
            out["spans"].append(_written(spans))
            out["n_added"].append(len(spans) - len(base))
        kinds = {k: pa.string() if k in ("base_sha256", "spans") else pa.int64() for k in out}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), **{k: pa.array(v, kinds[k]) for k, v in out.items()}})


def _docs(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def personal_data(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """Spans of personal data of every document.

    ``documents``: doc_id and text; other columns are ignored, whatever their names. Null and empty texts
    have no spans; rows with a null doc_id and repeated rows get a row each; an empty table gives an empty
    result. Offsets are code points, ends exclusive; of candidates that start together the longer one, of
    equal ones the kind listed first. Returns doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans
    (kind:start:end of base and added spans, by start, then kind), n_added.
    """
    docs = _docs(documents)
    found = docs.mapInArrow(partial(_detect, at="text", to="found"), f"doc_id long, text string, found {_SPAN}").select("doc_id", "found")
    found = keep(found, "found")
    weights = documents.sparkSession.sparkContext.broadcast(fitted(found, ["doc_id"]))
    return found.mapInArrow(partial(_report, weights=weights, least=least), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


@lean
def _redact(batches: Iterator[pa.RecordBatch], text: str, found: str, weights, least: float) -> Iterator[pa.RecordBatch]:
    for batch in (whole.slice(k, 512) for whole in batches for k in range(0, whole.num_rows, 512)):
        at, of = (batch.schema.get_field_index(k) for k in (text, found))
        out = []
        for old, spans in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist()):
            if not spans:
                out.append(old)
                continue
            pieces, last = [], 0
            for start, _, kind, end in _stands(spans, weights.value, least):
                if end <= last:
                    continue
                pieces += [old[last : max(start, last)], f"[{kind.upper()}]" if start >= last else ""]
                last = end
            out.append("".join([*pieces, old[last:]]))
        columns = [pa.array(out, batch.schema.field(at).type) if k == at else c for k, c in enumerate(batch.columns) if k != of]
        yield pa.RecordBatch.from_arrays(columns, names=[n for n in batch.schema.names if n != found])


def redact(documents: DataFrame, least: float = 0.8) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in brackets.

    All rows and columns stay, null texts too; repeated rows are redacted alike; an empty table gives an empty
    result. Texts are searched once: rows are written with their candidates and read again for the verdicts.
    """
    column = "__found"
    while column in documents.columns:
        column += "_"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema.fields)
    seen = keep(documents.mapInArrow(partial(_detect, at="text", to=column), f"{schema}, `{column}` {_SPAN}"), "found")
    weights = documents.sparkSession.sparkContext.broadcast(fitted(seen.select("doc_id", F.col(column).alias("found")), ["doc_id"]))
    return seen.mapInArrow(partial(_redact, text="text", found=column, weights=weights, least=least), schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """Spans of every document of ``documents``; see :func:`personal_data`."""
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
