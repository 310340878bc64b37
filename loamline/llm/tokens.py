"""Token counts: a map-side lookup in two tiers.

Tier one is a compact table of frequent pre-tokens and their token counts, broadcast to the workers. A
byte-pair vocabulary is the list of strings that its makers' corpus had most often, so the table is
made from the vocabulary, is bounded by its size and needs no pass over the corpus. Tier two is a cache
in each Python worker: a pre-token that misses the table is encoded once by the tokenizer's own model
and remembered. Nothing but the counts leaves a task, so there is no shuffle.
"""

from __future__ import annotations

import json
import zlib

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, pick

#: Fixed value: the pattern of the byte-level pre-tokenizer, with white space by its Unicode property.
BYTE_LEVEL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Longer pre-tokens are encoded anew each time and not remembered.
CACHED_CHARS = 64
#: Pre-tokens that a worker remembers in each of its two generations.
CACHED = 300_000
#: Matches handled at a time, so that a very long text makes no very long list.
CHUNK = 1 << 20


def byte_alphabet() -> dict[int, str]:
    """Byte to printable character: printable Latin-1 stands for itself, the rest follows from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def frequent_table(tokenizer_json: str) -> bytes:
    """Packed table of the vocabulary's entries that are a whole pre-token: strings, then counts."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_str(tokenizer_json)
    back = {c: b for b, c in byte_alphabet().items()}
    pattern = regex.compile(BYTE_LEVEL)
    words = []
    for entry in tok.get_vocab(with_added_tokens=False):
        try:
            word = bytes(back[c] for c in entry).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if "\x00" not in word and pattern.findall(word) == [word]:
            words.append(word)
    words.sort()
    table = byte_alphabet()
    counts = bytes(min(255, len(tok.model.tokenize(w.encode().decode("latin-1").translate(table)))) for w in words)
    return zlib.compress("\x00".join(words).encode() + b"\x00\x00" + counts)


def unpack(table: bytes) -> dict[str, int]:
    words, _, counts = zlib.decompress(table).partition(b"\x00\x00")
    return {w: n for w, n in zip(words.decode().split("\x00"), counts, strict=True) if n < 255} if words else {}


class Counter:
    """Counts one text's tokens; lives as long as its worker."""

    def __init__(self, tokenizer_json: str, table: bytes):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        pre = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        #: Anything but the byte-level form goes through the library as a whole.
        self.plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not (spec["model"].get("unk_token")) and not any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added)
        self.special = regex.compile("|".join(regex.escape(a["content"]) for a in sorted(added, key=lambda a: -len(a["content"])))) if added else None
        self.pattern = regex.compile(BYTE_LEVEL)
        self.letters = byte_alphabet()
        self.young: dict[str, int] = unpack(table)
        self.frequent = self.young
        self.young, self.old = {}, {}

    def miss(self, word: str) -> int:
        n = self.young.get(word) or self.old.get(word)
        if n is None:
            n = len(self.tok.model.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters)))
        if len(word) <= CACHED_CHARS:
            if len(self.young) >= CACHED:
                self.young, self.old = {}, self.young
            self.young[word] = n
        return n

    def part(self, text: str) -> int:
        if len(text) <= CHUNK:
            return self.sum(self.pattern.findall(text))
        total, held = 0, []
        for m in self.pattern.finditer(text):
            held.append(m.group())
            if len(held) == CHUNK:
                total, held = total + self.sum(held), []
        return total + self.sum(held)

    def sum(self, words: list[str]) -> int:
        total = 0
        missed = []
        for w, n in zip(words, map(self.frequent.get, words)):
            if n is None:
                missed.append(w)
            else:
                total += n
        young, miss = self.young, self.miss
        for w, n in zip(missed, map(young.get, missed)):
            total += miss(w) if n is None else n
        return total

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.plain:
            return len(self.tok.encode(text, add_special_tokens=False).ids)
        if self.special is None or self.special.search(text) is None:
            return self.part(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(self.part(p) for p in parts if p)


_COUNTERS: dict[int, Counter] = {}


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    The counts are those of the tokenizers library for the file at tokenizer_path, without added
    tokens, and with special strings inside a text read as the library reads them by default.
    Null and empty texts have 0 bytes and 0 tokens; rows with a null or repeated id are counted one by
    one; an empty table gives an empty result; extra columns are left out.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast((spec, frequent_table(spec)))  # bounded by the vocabulary file
    name = zlib.crc32(spec.encode())
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()

    def task():
        if name not in _COUNTERS:
            _COUNTERS[name] = Counter(*shared.value)
        count = _COUNTERS[name].count
        return lambda c: {"id": c["id"], "n_bytes": c["n_bytes"], "n_tokens": [count(t) for t in c["text"]]}

    sized = rows.withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    out = arrow_map(sized, task, f"id {id_type}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
