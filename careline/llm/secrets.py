"""Secrets in text: fixed patterns, and strings that a primed compressor cannot foresee."""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
                    r"""([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the runs of `[0-9a-f]+` that are long enough
#: What a text must hold in some case for ASSIGN to match.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")

#: Words that make what follows sensitive: alone, in the plural, or as a part of a camel-case name.
SENSITIVE = re.compile(
    r"(?:(?<![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
    r"(?:passwords?|passwd|passphrases?|passcodes?|pwd|secrets?|tokens?|credentials?|"
    r"authorization|bearer|api[_ -]?keys?|access[_ -]?keys?|private[_ -]?keys?|"
    r"signing[_ -]?keys?|client[_ -]?secrets?|auth|keys?)"
    r"(?:(?![A-Za-z])|(?-i:(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))",
    re.IGNORECASE | re.ASCII)
SENSITIVE_WORDS = ("pass", "pwd", "secret", "token", "cred", "auth", "bearer", "key")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=@!#$%^&*?~-]{16,}")
#: A candidate without the sign that assigns it.
VALUE = re.compile(r"[A-Za-z0-9+/_@!#$%^&*?~-]{16,}")
#: Signs at the ends of a candidate that don't tell it from another.
MARGIN = "=+/_-@!#$%^&*?~"
LEAST_CHARACTERS = 16
NAME_REST = re.compile(r"(?:[A-Za-z][A-Za-z0-9]*)?")
#: Pairs of letters of which words and names in European languages mostly consist; to the
#: compressor a short word costs as much as random letters.
PAIRS = frozenset((
    "ab ac ad ag ai al am an ap ar as at au ba be bi bl bo bu ca ce ch ci ck cl co cr ct cu da de "
    "di dl do ds du ea ec ed ee ef eg el em en ep er es et ev ex fa fe ff fi fl fo fr fu ge gi gr "
    "gs ha he hi ho ia ib ic id ie if ig il im in io ip ir is it iv iz ke la ld le li ll lo ls lt "
    "lu ly ma me mi mo mp na nc nd ne nf ng ni nn no ns nt nu ob oc od ol om on oo op or os ot ou "
    "ow pa pe pi pl po pp pr pt qu ra rc rd re rg ri rm rn ro rr rs rt ru ry sa sc se sh si so sp "
    "ss st su sy ta tc te th ti tl to tp tr ts tt tu ty ub ue ul um un up ur us ut va ve vi wa we "
    "wi xt yp ze").split())
#: Share of such pairs from which a string without digits is made of words.
WORDLIKE = 0.55
#: Names that code repeats; content of the compressor's dictionary.
IDENTIFIERS = (
    "password passwd passphrase username user_name secret secret_key client_secret client_id "
    "token access_token refresh_token id_token api_key apikey api-key x-api-key private_key "
    "public_key signing_key encryption_key authorization Authorization: Bearer Basic credentials "
    "aws_access_key_id aws_secret_access_key connection_string database_url config settings "
    "environment production development localhost example export const let var static final "
    "String string return function def class self this import from os.environ getenv process.env "
    "null None true false http:// https:// .com .org value default header Content-Type "
    "application/json sha256 sha512 md5 base64 encode decode utf-8 checksum digest signature "
    "version revision commit identifier session session_id request_id transaction_id uuid "
    "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ_-+/="
).encode()
#: Characters of surrounding text before and after a candidate that prime the compressor.
SURROUNDING = 512
#: From so many characters behind a sensitive word on, what a candidate costs counts less, half of it
#: after HALVED more.
NEAR, HALVED = 32, 512
NOVELTY = 0.65

Span = tuple[str, int, int, float]


def base_spans(text: str) -> list[Span]:
    """Whole matches, leftmost and not overlapping within a kind; too short ones dropped."""
    spans: list[Span] = []
    folded = text.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        spans += [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text)
                  if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= 16]
    return spans + [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]


class Novelty:
    """Marginal compressed bytes of a string after its surroundings and the identifiers."""

    def __init__(self) -> None:
        self._compressor = zstandard.ZstdCompressor(
            level=9, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                IDENTIFIERS, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def __call__(self, text: str, start: int, end: int) -> float:
        """Copies of the string don't count as surroundings."""
        core = core_of(text[start:end])
        around = (without(text, max(0, start - SURROUNDING), start, core) + "\n"
                  + without(text, end, end + SURROUNDING, core) + "\n").encode()
        own = text[start:end].encode()
        size = self._compressor.compress
        return (len(size(around + own)) - len(size(around))) / len(own)


def core_of(string: str) -> str:
    return string.strip(MARGIN) or string


def without(text: str, start: int, end: int, core: str) -> str:
    """text[start:end] less the occurrences of core, also those the ends cut."""
    parts, kept_to = [], start
    at = text.find(core, max(0, start - len(core) + 1), end + len(core) - 1)
    while at >= 0:
        parts.append(text[kept_to:max(kept_to, min(at, end))])
        kept_to = max(kept_to, at + len(core))
        at = text.find(core, at + len(core), end + len(core) - 1)
    return "".join([*parts, text[kept_to:end]])


def made_of_words(string: str) -> bool:
    """No digits, and neighbouring letters pair as they do in words and names."""
    if any(c.isdigit() for c in string):
        return False
    folded = string.lower()
    pairs = [a + b for a, b in zip(folded, folded[1:]) if a.isalpha() and b.isalpha()]
    return sum(p in PAIRS for p in pairs) >= WORDLIKE * len(pairs)


class Taken:
    """Spans by start; tells whether another one meets them."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.upto = [], []  # starts, and the furthest end so far
        for start, end in sorted(spans):
            self.starts.append(start)
            self.upto.append(max(end, self.upto[-1] if self.upto else end))

    def meets(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.upto[i - 1] > start


def sensitive_candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, characters since the sensitive word) of strings behind one on its line, in order.

    One pass over words and strings together. What a name goes on with belongs to the sensitive word in it.
    """
    ends: list[int] = []
    for word in SENSITIVE.finditer(text):
        if not ends or word.end() > ends[-1]:
            ends.append(NAME_REST.match(text, word.end()).end())
    found, i, line, at = [], 0, 0, 0
    for m in CANDIDATE.finditer(text) if ends else ():
        start, end = m.span()
        line = max(line, text.rfind("\n", at, start) + 1)
        at = start
        while i < len(ends) and ends[i] <= start:
            i += 1
        if i < len(ends) and ends[i] < end:
            start, since = ends[i], 0
        elif i and ends[i - 1] >= line:
            since = start - ends[i - 1]
        else:
            continue
        if end - start >= LEAST_CHARACTERS and not made_of_words(text[start:end]):
            found.append((start, end, since))
    return found


def novel_spans(text: str, known: list[Span], novelty: Novelty, least: float) -> list[Span]:
    """Incompressible strings behind a sensitive word, apart from the known spans, and all their copies.

    What a string costs falls off with its distance from the word; of its places the best one counts.
    """
    folded = text.lower()
    if not any(w in folded for w in SENSITIVE_WORDS):
        return []
    taken = Taken([(s, e) for _, s, e, _ in known])
    found = [(s, e, d) for s, e, d in sensitive_candidates(text) if not taken.meets(s, e)]
    values: dict[str, float] = {}
    for start, end, since in found:
        core = core_of(text[start:end])
        weight = HALVED / (HALVED + max(0, since - NEAR))
        if 2 * weight >= least:  # no string costs two bytes a character
            values[core] = max(novelty(text, start, end) * weight, values.get(core, 0.0))
    secret = {core: value for core, value in values.items() if value >= least}
    spans = [("novel", s, e, secret[core]) for s, e, _ in found
             if (core := core_of(text[s:e])) in secret]
    if secret:
        own = Taken([(s, e) for _, s, e, _ in spans])
        spans += [("novel", *m.span(), secret[core]) for m in VALUE.finditer(text)
                  if (core := core_of(m[0])) in secret
                  and not taken.meets(*m.span()) and not own.meets(*m.span())]
    return spans


def spans_of(text: str, novelty: Novelty, least: float) -> list[Span]:
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, novelty, least),
                  key=lambda s: (s[1], KINDS.index(s[0])))


def find_secrets(docs: DataFrame, novelty: float = NOVELTY) -> DataFrame:
    """(doc_id, secrets), one row for each row of `docs`; secrets: kind, start, end, novelty.

    Spans count code points, end exclusive, by start, then kind as in KINDS. The base kinds are
    the fixed patterns, on whole matches. `novel` spans stand behind a sensitive word on its line, are not
    made of words, and cost at least `novelty` compressed bytes a character when the compressor
    already knows the text around them, less their own copies, and a dictionary of identifiers; the cost
    counts less with the distance from the word. Every copy of such a string is reported. Texts of any length
    are searched whole, in time that grows with their length. A NULL text is empty and has none;
    repeated rows each get a row; other columns are ignored; no rows give none.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                      ("novelty", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "novelty"), s, strict=True))
                      for s in spans_of(text.as_py(), measure, novelty)]
                     for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))],
                                             ["doc_id", "secrets"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    return rows.mapInArrow(run, "doc_id long, secrets array<struct<kind:string,start:long,"
                                "end:long,novelty:double>>")


def redact(docs: DataFrame, novelty: float = NOVELTY, mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span of `find_secrets` replaced by `mark`; n_chars follows the text.

    All rows and columns stay; texts without secrets, NULL and empty ones are unchanged.
    """
    schema = docs.select("text", *[c for c in docs.columns if c != "text"]).schema
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Novelty()
        for batch in batches:
            texts, lengths = [], []
            old = (batch.column(batch.schema.get_field_index("n_chars")).to_pylist()
                   if counted else [None] * batch.num_rows)
            for value, n in zip(batch.column(0), old, strict=True):
                text = value.as_py()
                spans = spans_of(text, measure, novelty) if text else []
                if spans:
                    parts, at = [], 0
                    for _, start, end, _ in spans:
                        if start >= at:
                            parts += [text[at:start], mark]
                        at = max(at, end)
                    text = "".join([*parts, text[at:]])
                    n = len(text)
                texts.append(text)
                lengths.append(n)
            batch = batch.set_column(0, batch.schema.field(0), pa.array(texts, batch.column(0).type))
            if counted:
                i = batch.schema.get_field_index("n_chars")
                batch = batch.set_column(i, batch.schema.field(i),
                                         pa.array(lengths, batch.column(i).type))
            yield batch

    return docs.select(*schema.names).mapInArrow(run, schema).select(*docs.columns)
