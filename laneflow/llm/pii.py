"""Personal data: base patterns, and a character BiLSTM with a CRF that finds what they miss.

The network is trained in the job, from labelled spans: the base patterns' matches in a bounded
sample of windows of the documents, and spelled-out, spaced or unusual ones written into such windows
by rule (e-mail addresses with "at" and "dot", telephone numbers without "+", shorter cards, keys and
passwords). Every whole text is cut into overlapping windows, all windows are decoded, and where two
overlap each decides on its own half of the overlap. Spans of the whole text are then put together,
checked for what their kind must have, and dropped where a base span stands.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import bilstm, shared
from laneflow.llm.shared import F

#: Kinds in the order of the results; tag k of the network is kind k - 1, tag 0 is no span.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
SECRET = 4
#: Characters that a span neither begins nor ends with.
EDGES = " \t\n\r,;:.#*$%&|<>!"
WINDOW, OVERLAP = 448, 64
HIDDEN, STEPS, BATCH, SEED = 6, 240, 192, 6
#: Documents that training windows are taken from, windows of each, and their characters.
SAMPLE, EACH, TRAIN_WINDOW = 600, 4, 112
ROWS = 1024

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Character classes: pad, other, capital, digit, line end, then the printable rest of ASCII.
OTHER, CAPITAL, DIGIT, LINE = 1, 2, 3, 4
PLAIN = [c for c in range(32, 127) if not (65 <= c <= 90 or 48 <= c <= 57)]
CLASSES = 5 + len(PLAIN)


def class_table() -> np.ndarray:
    out = np.full(128, OTHER, np.uint8)
    out[65:91], out[48:58], out[[10, 13]] = CAPITAL, DIGIT, LINE
    out[PLAIN] = np.arange(5, CLASSES)
    out[9] = out[32]
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns: by kind as listed, then start."""
    out = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(p[-4:]) <= 255 and not p[:-3].strip("0") for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


def invented(random: np.random.Generator) -> tuple[int, str]:
    """A kind and a string of it that the base patterns mostly miss."""

    def digits(n: int) -> str:
        return "".join(map(str, random.integers(0, 10, n)))

    def letters(n: int, of: str = "abcdefghijklmnopqrstuvwxyz") -> str:
        return "".join(of[k] for k in random.integers(0, len(of), n))

    kind = int(random.integers(0, len(KINDS)))
    if kind == 0:
        name, host = letters(int(random.integers(3, 9))), letters(int(random.integers(3, 9)))
        name += random.choice(["", "." + letters(4), digits(2), "." + digits(2)])
        at, dot = random.choice([" at ", " [at] ", "(at)", "@", " @ "]), random.choice([" dot ", "[dot]", ".", "(dot)"])
        return kind, f"{name}{at}{host}{dot}{random.choice(['com', 'org', 'net', 'example.com'])}"
    if kind == 1:
        parts = [str(x) for x in random.integers(1, 256, 4)]
        return kind, random.choice([".", " . ", "[.]"]).join(parts)
    if kind == 2:
        gap = random.choice(["", " ", "-"])
        return kind, random.choice([gap.join(digits(4) for _ in range(4)), f"3{digits(3)}{gap}{digits(6)}{gap}{digits(5)}"])
    if kind == 3:
        a, b, c = digits(3), digits(3), digits(4)
        return kind, random.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"00{digits(2)} {a} {b} {c}", f"{a}.{b}.{c}"])
    hexa = letters(int(random.integers(16, 42)), "0123456789abcdef")
    word = random.choice(["password", "token", "secret", "api_key", "passwd"])
    return kind, random.choice(
        ["AKIA" + letters(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), f"{word}={hexa}", f'{word} = "{hexa}"', f"{word}: {hexa}", "sk-" + letters(32, "abcdefghijklmnopqrstuvwxyz0123456789")]
    )


def training_set(texts: list[str], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Character classes and tags (places x rows) of windows of the texts, half of them written into."""
    random = np.random.default_rng(seed)
    table = class_table()
    chars, tags = [], []
    for text in [*texts, "Plain words, with a comma. And 12 more in 2024: 3.5 percent (see page 7-9)."]:
        for _ in range(EACH):
            start = int(random.integers(0, max(1, len(text) - TRAIN_WINDOW // 2)))
            some = text[start : start + TRAIN_WINDOW]
            spans = base_spans(some)
            if random.random() < 0.6:
                kind, inner = invented(random)
                at = some.find(" ", int(random.integers(0, max(1, len(some) - len(inner))))) + 1
                if not any(a < at < b for _, a, b in spans):
                    some = f"{some[:at]}{inner} {some[at:]}"
                    spans = [(kind, at, at + len(inner)), *((k, a, b) for k, a, b in base_spans(some) if b <= at or a >= at + len(inner))]
            tag = np.zeros(TRAIN_WINDOW, np.int8)
            for k, a, b in spans:
                tag[a:b] = k + 1
            chars.append(classes_of(some[:TRAIN_WINDOW], table, TRAIN_WINDOW))
            tags.append(tag)
    return np.array(chars).T.copy(), np.array(tags).T.copy()


def classes_of(text: str, table: np.ndarray, length: int) -> np.ndarray:
    out = np.full(length, bilstm.PAD, np.uint8)
    codes = points(text)[:length]
    out[: len(codes)] = np.where(codes < 128, table[np.minimum(codes, 127)], OTHER)
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trained(docs: DataFrame, sample: int = SAMPLE) -> bilstm.Network:
    """A network trained on windows of the ``sample`` documents with the least hashes.

    The windows are drawn inside the tasks; the driver gets ``sample * EACH`` of them at most.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = (
        docs.select(F.xxhash64(text).alias("h"), F.length(text).alias("n"), text.alias("text"))
        .withColumn("from", F.pmod("h", F.greatest(F.col("n") - 4 * TRAIN_WINDOW, F.lit(1))))
        .select("h", F.expr(f"substring(text, int(`from`) + 1, {4 * TRAIN_WINDOW})").alias("text"))
        .groupBy("h")
        .agg(F.min("text").alias("text"))
        .orderBy("h")
        .limit(sample)
        .collect()
    )
    chars, tags = training_set([r.text for r in rows])
    return bilstm.train(chars, tags, CLASSES, HIDDEN, len(KINDS) + 1, STEPS, BATCH, SEED)


def plausible(kind: int, span: str) -> bool:
    """Whether a decoded span has what its kind must have."""
    digits, n = sum("0" <= c <= "9" for c in span), len(span)
    if kind == 0:
        return n >= 8 and ("@" in span or re.search(r"\bat\b", span)) and bool(re.search(r"\.|\bdot\b", span)) and "\n" not in span
    if kind == 1:
        numbers = re.findall("[0-9]+", span)
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers) and digits * 3 >= n
    if kind == 2:
        return 13 <= digits <= 19 and not re.search("[^0-9 -]", span) and luhn("".join(c for c in span if "0" <= c <= "9"))
    if kind == 3:
        return 9 <= digits <= 15 and not re.search(r"[^0-9 ().+-]", span)
    return n >= 16 and digits >= 2 and max(map(len, re.findall(r"[A-Za-z0-9_-]+", span)), default=0) >= 14


def decoded(texts: list[str], net: bilstm.Network, table: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """Spans that the network finds in each text: all windows decoded, then put together."""
    lengths = np.array([len(t) for t in texts], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    codes = points("".join(texts))
    flat = np.where(codes < 128, table[np.minimum(codes, 127)], np.uint8(OTHER))
    step = WINDOW - OVERLAP
    n = np.where(lengths > WINDOW, -(-(lengths - OVERLAP) // step), (lengths > 0).astype(np.int64))
    row = np.repeat(np.arange(len(texts)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    start = offsets[row] + nth * step
    size = np.minimum(WINDOW, offsets[row + 1] - start)
    tags = np.zeros(len(flat), np.int8)
    for rows in np.array_split(np.argsort(-size, kind="stable"), max(1, -(-len(size) // ROWS))):
        if not len(rows):
            continue
        places = np.arange(int(size[rows].max()))[:, None]
        inside = places < size[rows]
        at = np.minimum(start[rows] + places, len(flat) - 1)
        found = bilstm.decode(net, np.where(inside, flat[at], np.uint8(bilstm.PAD)))
        some = np.flatnonzero(found.any(axis=0))
        # Of an overlap, the left window decides on the first half and the right one on the second.
        low = np.where(nth[rows] > 0, OVERLAP // 2, 0)[some]
        last = (start + size >= offsets[row + 1])[rows[some]]
        high = np.where(last, size[rows[some]], WINDOW - OVERLAP // 2)
        mine = (places >= low) & (places < high)
        tags[at[:, some][mine]] = found[:, some][mine]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], tags, [0]])) != 0)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if tags[a]:
            r = int(np.searchsorted(offsets, a, side="right")) - 1
            b = min(b, int(offsets[r + 1]))
            out[r].append((int(tags[a]) - 1, a - int(offsets[r]), b - int(offsets[r])))
    return out


def spans_of(texts: list[str], net: bilstm.Network) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, sorted by kind and start."""
    out = []
    for text, more in zip(texts, decoded(texts, net, class_table()), strict=True):
        base = base_spans(text)
        added = []
        for kind, a, b in more:
            while kind == SECRET and a > 0 and not text[a - 1].isspace():  # keys are whole words
                a -= 1
            while kind == SECRET and b < len(text) and not text[b].isspace():
                b += 1
            while a < b and text[a] in EDGES:
                a += 1
            while a < b and text[b - 1] in EDGES:
                b -= 1
            if plausible(kind, text[a:b]) and not any(x < b and a < y for _, x, y in base):
                added.append((kind, a, b))
        out.append((base, sorted(base + added)))
    return out


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def digests(docs: DataFrame, net: bilstm.Network) -> DataFrame:
    """Counts, digest and list of spans of every row; null text is empty. Extra columns are ignored."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        found = spans_of(shared.texts(part), shipped.value)
        counts = [[sum(s[0] == k for s in base) for base, _ in found] for k in range(len(BASE))]
        return pa.RecordBatch.from_arrays(
            [
                part.column("doc_id"),
                *(pa.array(c, pa.int64()) for c in counts),
                pa.array([shared.hex_digest(written(base).encode()) for base, _ in found], pa.string()),
                pa.array([written(spans) for _, spans in found], pa.string()),
            ],
            ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
        )

    counts = ", ".join(f"n_{k} long" for k in BASE)
    return shared.per_batch(shared.id_and_text(docs), find, f"doc_id long, {counts}, base_sha256 string, spans string")


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, overlapping ones together, as the name of its kind in brackets."""
    out, end = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{KINDS[kind].upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redacted(docs: DataFrame, net: bilstm.Network) -> DataFrame:
    """All columns of ``docs``, ``text`` with its spans replaced and ``n_chars``, if there, to match."""
    shipped = docs.sparkSession.sparkContext.broadcast(net)

    def replace(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = shared.texts(part)
        found = spans_of(texts, shipped.value)
        new = [redact(t, spans) if spans else t for t, (_, spans) in zip(texts, found, strict=True)]
        null = part.column("text").is_null().to_pylist()
        columns = {name: part.column(name) for name in part.schema.names}
        columns["text"] = pa.array([None if n else t for t, n in zip(new, null, strict=True)], part.schema.field("text").type)
        if "n_chars" in columns:
            kept = part.column("n_chars").to_pylist()
            sizes = [len(t) if spans else k for t, k, (_, spans) in zip(new, kept, found, strict=True)]
            columns["n_chars"] = pa.array(sizes, part.schema.field("n_chars").type)
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return shared.per_batch(docs, replace, docs.schema)


def op6_bilstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text of ``documents``."""
    docs = shared.table(spark, sf_dir, "documents")
    return digests(docs, trained(docs))
