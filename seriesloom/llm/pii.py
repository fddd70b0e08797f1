"""Personal data: base patterns, weak labelers, expectation-maximisation and a span classifier.

The four base patterns give spans that always stay. Looser patterns give further candidates, of the same kinds and of a fifth,
secrets. Six labelers vote on every candidate (yes, no or nothing): a strict pattern of its form, a checksum or range test, a
gazetteer, cue words around it, its borders and its size. Votes are counted by pattern over the whole table;
expectation-maximisation finds how reliable each labeler is and how likely each pattern is personal data. Those
likelihoods are the soft labels of the final classifier of each kind, a logistic model over hashed features of the span
itself (characters, shape, size) and of its context (words and signs around it), fitted on a bounded sample of candidates.
All that leaves the executors are the counts, at most 3**6 patterns of each kind, and the sample's features.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.shared import checkpointed, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("form", "test", "gazetteer", "context", "borders", "digits")

#: Gazetteers and cue words, by kind.
COMMON_ENDINGS = frozenset("com net org edu gov info io co biz uk de fr es it nl eu us ca au jp br in ru ch at be se no".split())
CUES = {
    "email": "mail email e-mail contact write reply correo courriel kontakt",
    "ip": "ip host server address addr ping gateway node adresse",
    "card": "card visa mastercard credit debit payment amex tarjeta carte karte",
    "phone": "phone call tel fax mobile cell telephone dial ring movil telefon anruf",
    "secret": "password passwd pwd secret token key api_key apikey credential credentials auth authorization bearer login clave",
}
NOT_CUES = "version ver v build section chapter figure order invoice isbn id no nr part serial model commit sha sha1 sha256 md5 checksum hash digest uuid revision"
DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ")
#: Bounds of the classifier: candidates of its sample per kind, hashed features, and those of one span.
SAMPLED, DIMENSIONS = 4000, 1 << 13

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|\(dot\)|\[dot\]) ?[A-Za-z0-9-]{1,63})+"),
    "phone": re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"),
    "card": re.compile(r"(?<![0-9A-Za-z.-])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9A-Za-z])"),
    "ip": re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![0-9A-Za-z:])"),
    "secret": re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key)[ ]?[=:][ ]?[\"']?(?P<value>[^\s\"',;]{8,128})|(?<![0-9A-Za-z])(?P<bare>(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z_-]{20,128}|xox[bp]-[0-9A-Za-z-]{10,128}|AIza[0-9A-Za-z_-]{35}|[0-9a-f]{32,128})(?![0-9A-Za-z])"),
}
#: What a careful writer's form of each kind looks like.
_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[._+-]?[A-Za-z0-9])*@[A-Za-z0-9](?:-?[A-Za-z0-9])*(?:\.[A-Za-z0-9](?:-?[A-Za-z0-9])*)*\.[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:0|[1-9][0-9]{0,2})(?:\.(?:0|[1-9][0-9]{0,2})){3}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}"),
    "card": re.compile(r"[0-9]{16,19}|[0-9]{4}(?:([ -])[0-9]{4})(?:\1[0-9]{4})+(?:\1?[0-9]{1,3})?"),
    "phone": re.compile(r"\+[0-9]{1,3}(?: ?\([0-9]{1,4}\))?(?:[ .-]?[0-9]{2,4}){2,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"),
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[0-9A-Za-z_+/=.-]{16,128}"),
}
_CUE = {k: re.compile(rf"(?<!\w)(?:{'|'.join(v.split())})(?!\w)", re.I) for k, v in CUES.items()}
_NOT_CUE = re.compile(rf"(?<!\w)(?:{'|'.join(NOT_CUES.split())})(?!\w)", re.I)
NEAR = 32


def digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost matches, found from each @ outwards, so that long runs without an @ cost nothing."""
    floor, at = 0, text.find("@")
    while at >= 0:
        left = text[floor:at]
        start = floor + len(left.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Leftmost non-overlapping matches of each kind that pass its test; matches that fail are dropped."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE_KINDS}
    if "@" in text:
        out["email"] = list(base_emails(text))
    if _DIGIT.search(text):
        out["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
        out["card"] = [m.span() for m in _CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> Iterator[tuple[str, int, int]]:
    """Candidates of the looser patterns that overlap no base span."""
    taken = sorted(s for spans in base.values() for s in spans)
    starts = [a for a, _ in taken]
    has_digit = _DIGIT.search(text) is not None
    for kind in KINDS:
        may = ("(at)" in text or "[at]" in text) if kind == "email" else has_digit and (kind != "ip" or text.count(":") >= 7)
        for m in _LOOSE[kind].finditer(text) if may else ():
            start, end = m.span(m.lastgroup) if m.lastgroup else m.span()
            near = bisect.bisect_left(starts, end)  # base spans of one kind don't overlap, so few before this can reach start
            if not any(a < end and start < b for a, b in taken[max(0, near - 2 * len(KINDS)) : near]):
                yield kind, start, end


def votes(text: str, kind: str, start: int, end: int) -> str:
    """One of + - 0 for each labeler."""
    span, before = text[start:end], text[max(0, start - NEAR) : start]
    number = digits(span)
    strict = "+" if _STRICT[kind].fullmatch(span) else "-" if kind != "secret" else "0"
    if kind == "email":
        name = re.split(r"[.\s)\]]+", span.rstrip(")]"))[-1].lower()
        test = "+" if "." in span else "0"
        known = "+" if name in COMMON_ENDINGS else "-"
        size = "+" if len(span) <= 80 else "-"
    elif kind == "ip":
        parts = span.split(".")
        test = "+" if len(parts) == 4 and all(p == "0" or p[0] != "0" for p in parts) else "0"
        known = "-" if span.startswith(("0.", "255.", "127.")) else "+"
        size = "+" if len(span) >= 7 else "-"
    elif kind == "card":
        test = "+" if luhn(number) else "-"
        known = "+" if number[0] in "3456" else "-"
        size = "+" if len(number) == 16 else "0"
    elif kind == "phone":
        test = "+" if 10 <= len(number) <= 13 else "-"
        known = "-" if len(set(number[-7:])) == 1 else "+"
        size = "+" if 8 <= len(number) <= 15 else "-"
    else:
        test = "+" if bits_a_character(span) >= 3 else "-" if bits_a_character(span) < 2.5 else "0"
        plain = set(span) <= set("0123456789abcdef") and len(span) in DIGEST_SIZES and not _CUE[kind].search(before)
        known = "+" if span.startswith(SECRET_STARTS) else "-" if plain else "0"
        size = "+" if len(span) >= 16 and len(span) not in DIGEST_SIZES else "0"
    cues = _CUE[kind].search(before) or (kind == "secret" and _CUE[kind].search(text[max(0, start - 3) : start]))
    context = "+" if cues else "-" if _NOT_CUE.search(before) else "0"
    inside = (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return strict + test + known + context + ("-" if inside else "+") + size


def bits_a_character(span: str) -> float:
    """Entropy of the span's own characters."""
    return -sum(n / len(span) * math.log2(n / len(span)) for n in Counter(span).values())


def span_features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Places, below DIMENSIONS, of features of the span and its context."""
    span, before, after = text[start:end], text[max(0, start - NEAR) : start], text[end : end + NEAR]
    shape = re.sub(r"(.)\1+", r"\1", "".join("9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in span[:80]))
    words_before, words_after = re.findall(r"\w+", before.lower())[-3:], re.findall(r"\w+", after.lower())[:2]
    number = digits(span)
    names = ["bias", f"shape {shape[:40]}", f"length {min(len(span), 64) // 4}", f"digits {len(number)}", f"share {10 * len(number) // max(len(span), 1)}", f"bits {int(2 * bits_a_character(span))}", f"first {span[:1]}", f"ending {re.split(r'[^A-Za-z0-9]+', span)[-1][:8].lower() if kind == 'email' else ''}"]
    names += [f"starts {p}" for p in SECRET_STARTS if span.startswith(p)] + [f"luhn {luhn(number)}", f"sign before {text[start - 1 : start]}", f"sign after {text[end : end + 1]}"]
    names += [f"word before {w}" for w in words_before] + [f"word after {w}" for w in words_after] + [f"last word {w}" for w in words_before[-1:]]
    return sorted({zlib.crc32(f"{kind} {n}".encode("utf-8", "surrogatepass")) % DIMENSIONS for n in names})


SPAN = "struct<kind: string, start: long, end: long, votes: string, features: array<int>, base: boolean>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.string()), ("features", pa.list_(pa.int32())), ("base", pa.bool_())])


def candidates(text: str) -> list[dict]:
    """Base and looser spans of a text by kind, then start, with votes and features."""
    base = base_spans(text)
    own = [(k, a, b, True) for k in BASE_KINDS for a, b in base[k]] + [(*x, False) for x in loose_spans(text, base)]
    own.sort(key=lambda x: (KINDS.index(x[0]), x[1]))
    return [{"kind": k, "start": a, "end": b, "votes": votes(text, k, a, b), "features": span_features(text, k, a, b), "base": is_base} for k, a, b, is_base in own]


def finder() -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            counts, shas, spans = {k: [] for k in BASE_KINDS}, [], []
            for text in batch.column(1).to_pylist():
                found = candidates(text or "")
                base = [x for x in found if x["base"]]
                for k in BASE_KINDS:
                    counts[k].append(sum(x["kind"] == k for x in base))
                shas.append(hashlib.sha256(",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in base).encode()).hexdigest())
                spans.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(counts[k], pa.int64()) for k in BASE_KINDS), pa.array(shas, pa.string()), pa.array(spans, pa.list_(_SPAN))], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "found"])

    return find


def reliabilities(patterns: list[tuple[str, float]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """P(vote | class) of each labeler, shape (labelers, 2, 3), and P(personal | pattern), by expectation-maximisation.

    Starts from the votes, a no counting as two yes; smoothed by one vote of each sort, with more weight on agreement.
    """
    code = np.array([["-0+".index(c) for c in p] for p, _ in patterns], dtype=np.int64).reshape(-1, len(LABELERS))
    count = np.array([n for _, n in patterns], dtype=np.float64)
    posterior = 1 / (1 + np.exp(-np.array([-2.0, 0.0, 1.0])[code].sum(axis=1)))
    rates = np.zeros((len(LABELERS), 2, 3))
    for _ in range(rounds):
        prior = (count @ posterior + 1) / (count.sum() + 2)
        log = np.stack([np.full(len(count), np.log(1 - prior)), np.full(len(count), np.log(prior))], axis=1)
        for j in range(len(LABELERS)):
            for c, p in ((0, 1 - posterior), (1, posterior)):
                smooth = np.array([3.0, 1.0, 1.0]) if c == 0 else np.array([1.0, 1.0, 3.0])
                rates[j, c] = np.bincount(code[:, j], count * p, minlength=3) + smooth
                rates[j, c] /= rates[j, c].sum()
                log[:, c] += np.log(rates[j, c])[code[:, j]]
        posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return rates, posterior


def span_classifier(features: list[list[int]], posterior: np.ndarray, share: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights of a logistic model on hashed features, fitted to the posteriors; share is how much a span of the sample counts."""
    rows = np.repeat(np.arange(len(features)), [len(f) for f in features])
    columns = np.concatenate([np.array(f, dtype=np.int64) for f in features]) if features else np.zeros(0, dtype=np.int64)
    share = share / share.sum()
    w = np.zeros(DIMENSIONS)
    fast = w.copy()
    for step in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, fast[columns], minlength=len(features)), -500, 500)))
        new = fast - 0.3 * (np.bincount(columns, (share * (p - posterior))[rows], minlength=DIMENSIONS) + 1e-4 * fast)
        fast = new + step / (step + 3) * (new - w)
        w = new
    return w


def fitted(counted: list[tuple[str, str, int]], sample: list[tuple[str, str, list[int]]]) -> np.ndarray:
    """The classifier's weights of all kinds, whose features lie apart: counted has (kind, votes, number), sample (kind, votes, features).

    A pattern of votes weighs in the sample as much as it does among all candidates of the kind.
    """
    weights = np.zeros(DIMENSIONS)
    for kind in KINDS:
        patterns = sorted((p, float(n)) for k, p, n in counted if k == kind)
        own = [(p, f) for k, p, f in sample if k == kind]
        if patterns and own:
            _, posterior = reliabilities(patterns)
            likely, number = dict(zip((p for p, _ in patterns), posterior, strict=True)), dict(patterns)
            drawn = Counter(p for p, _ in own)
            share = np.array([number[p] / drawn[p] for p, _ in own])
            weights += span_classifier([f for _, f in own], np.array([likely[p] for p, _ in own]), share)
    return weights


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans, and found: the spans with kind, start, end, votes, features, base.

    Null text counts as empty. The counts and the hash are those of the base spans; spans and n_spans add what the classifier
    takes, secrets as a kind of their own after the others. Positions are code points, ends exclusive. Whole texts are searched,
    whatever their length; repeated rows are searched each; an empty table gives no rows; other columns are ignored, whatever they
    are called.
    """
    schema = f"doc_id long, {', '.join(f'n_{k} long' for k in BASE_KINDS)}, base_sha256 string, found array<{SPAN}>"
    rows = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(finder(), schema))
    spans = rows.select(F.explode("found").alias("f"))
    counted = [tuple(r) for r in spans.groupBy("f.kind", "f.votes").count().collect()]
    # by a hash of what a span looks like, so that many equal ones don't fill the sample; every pattern of votes is in it
    draw = F.xxhash64("f.kind", "f.votes", "f.features")
    each = spans.select("f.kind", "f.votes", "f.features", draw.alias("draw")).groupBy("kind", "votes", "draw").agg(F.first("features").alias("features"))
    patterns = Counter(k for k, _, _ in counted)
    most = max([1, *patterns.values()])
    rank = F.row_number().over(Window.partitionBy("kind", "votes").orderBy("draw"))
    sample = [(r["kind"], r["votes"], r["features"]) for r in each.withColumn("rank", rank).where(F.col("rank") <= max(1, SAMPLED // most)).collect()]
    weights = fitted(counted, sample)

    def accept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[x for x in own if x["base"] or weights[x["features"]].sum() > 0] for own in batch.column(batch.num_columns - 1).to_pylist()]
            joined = [",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in own) for own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.list_(_SPAN)), pa.array(joined, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=[*batch.schema.names, "spans", "n_spans"])

    return rows.mapInArrow(accept, f"{schema}, spans string, n_spans long")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets, from right to left; needs unique identifiers."""
    found = find_personal_data(docs, id_col=id_col, text_col=text_col).select("doc_id", "found")
    ordered = F.reverse(F.array_sort("found", lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))
    start = F.struct(F.col("own").alias("text"), F.length("own").cast("long").alias("left"))

    def replace(acc: Column, s: Column) -> Column:
        after = F.substring(acc["text"], (s["end"] + 1).cast("int"), F.length(acc["text"]))
        cut = F.concat(F.substring(acc["text"], F.lit(1), s["start"].cast("int")), F.lit("<"), F.upper(s["kind"]), F.lit(">"), after)
        return F.when(s["end"] <= acc["left"], F.struct(cut.alias("text"), s["start"].alias("left"))).otherwise(acc)

    clean = F.aggregate(ordered, start, replace, lambda acc: acc["text"])
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("own"))
    joined = whole.join(found, F.col("id") == F.col("doc_id"), "left")
    text = F.when(F.col("found").isNull() | F.col("own").isNull(), F.col("own")).otherwise(clean)
    return joined.select(F.col("whole").withField(f"`{text_col}`", text).alias("whole")).select("whole.*")
