"""Exact BPE encoding by dynamic programming over the prefixes of a word.

Every prefix of a word has one encoding, and so one last token.  An automaton over the vocabulary yields, at each place, the
tokens that end there (the suffixes of the prefix), longest first; the last token is the one that may stand after the last token
of the prefix before it.  Two tokens may stand side by side when no merge across their border comes before the merges that
form them.  Following the last tokens back gives the ids.  Words repeat, so a task keeps the results of those it has met.

A null text is empty (no ids, both digests of the empty string); texts of any length are read as a whole, one word at a time;
repeated rows give repeated results; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from watchhouse.llm.common import worker_cache

SPACE = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
KEPT_WORDS = 500_000  # words of a generation a worker remembers
RARE = re.compile("[^\x00-\u024f\u0370-\u03ff\u0400-\u04ff\u2010-\u2027]").search
_PLAIN = re.compile("[\t-\r -~]*").fullmatch  # every character of a word stands for itself
END_BASE = 0xF0000  # stand-in characters for the last character of a word


class Remembered(dict):
    """Results by key, worked out when missing; two generations, so that what is in use outlives a turn."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, key):
        got = self.older.get(key)
        if got is None:
            got = self.make(key)
        self[key] = got
        return got

    def turn(self) -> None:
        """Start a new generation when this one is full; the one before it is forgotten."""
        if len(self) > KEPT_WORDS:
            self.older = dict(self)
            self.clear()


class PrefixEncoder:
    """Encoder and decoder for a word-level BPE file with an end-of-word suffix."""

    def __init__(self, path: str):
        import ahocorasick
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token_of = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split.replace(r"\s", SPACE[1:-1])).findall
        self.spaces = regex.compile(f"{SPACE}+").sub
        self.stops = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")").split
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = sorted(set(range(256)) - set(plain))
        self.byte_chars = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}
        units = {t: self._units(t) for t in model["vocab"] if t not in self.special}
        ids = {u: model["vocab"][t] for t, u in units.items()}
        self.length = {i: len(u) for u, i in ids.items()}
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.formed = dict.fromkeys(self.length, -1)  # rank of the merge that forms a token
        for rank, (left, right) in enumerate(model["merges"]):
            pair = (model["vocab"][left], model["vocab"][right])
            self.merge[pair] = rank
            whole = model["vocab"][left + right]
            self.parts[whole], self.formed[whole] = pair, rank
        self.pairs: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        reachable = {i for i in self.length if i not in self.parts}
        for token in sorted(self.parts, key=self.formed.get):
            left, right = self.parts[token]
            if left in reachable and right in reachable and self._compatible(left, right, self.formed[token]):
                reachable.add(token)
        for u, i in ids.items():
            if i in reachable:
                self.automaton.add_word(u, (i, len(u)))
        self.automaton.make_automaton()
        self.known = Remembered(self._word)
        self.others = Remembered(self._other)
        self.library = Tokenizer.from_file(path)

    def _units(self, token: str) -> str:
        """One character per unit: the word's last unit gets a character of its own."""
        if not token.endswith(self.suffix):
            return token
        bare = token[: -len(self.suffix)]
        return bare[:-1] + chr(END_BASE + ord(bare[-1]))

    def _edge(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The tokens that lie at one edge of ``token`` in the course of its forming: (id, rank that forms it, rank that uses it up)."""
        out, until = [], len(self.merge)
        while True:
            out.append((token, self.formed[token], until))
            if token not in self.parts:
                return out
            until = self.formed[token]
            token = self.parts[token][side]

    def _compatible(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether no merge across the border of two neighbours comes while both of its sides exist (and before a rank)."""
        for a, a_from, a_until in self._edge(left, 1):
            for b, b_from, b_until in self._edge(right, 0):
                rank = self.merge.get((a, b))
                # of two equal merges that overlap the left one goes first
                if rank is not None and a_from < rank < a_until and b_from < rank <= b_until and (before is None or rank < before):
                    return False
        return True

    def word_ids(self, units: str) -> list[int]:
        """Ids of one word given as unit characters."""
        last: list[int] = [-1] * len(units)
        pairs = self.pairs
        for end, (token, size) in self.automaton.iter(units):
            if last[end] >= 0:
                continue
            start = end - size
            if start < 0:
                last[end] = token
                continue
            pair = last[start] << 20 | token
            fits = pairs.get(pair)
            if fits is None:
                fits = pairs[pair] = self._compatible(last[start], token)
            if fits:
                last[end] = token
        out, at = [], len(units) - 1
        while at >= 0:
            token = last[at]
            out.append(token)
            at -= self.length[token]
        out.reverse()
        return out

    def _word(self, chars: str) -> tuple[str, str]:
        """Ids as text and tokens as text of a word given as byte stand-ins."""
        ids = self.word_ids(chars[:-1] + chr(END_BASE + ord(chars[-1])))
        return " ".join(map(str, ids)), " ".join(map(self.token_of.__getitem__, ids))

    def _other(self, word: str) -> tuple[str, str]:
        """The same for a word of any characters, in lower case."""
        return self.known["".join(map(self.byte_chars.__getitem__, word.encode()))]

    def _rare(self, chunk: str) -> list[tuple[str, str]]:
        """A stretch whose normal form or classes may differ between Unicode versions, read by the library's own rules."""
        normal = self.library.normalizer.normalize_str(chunk)
        return [self.known[w] for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def _words_of(self, piece: str) -> list[tuple[str, str]]:
        """Results of the words of a piece of text, in order."""
        if piece.isascii():
            # white space parts words, and no other character of a piece without controls is left out
            return list(map(self.known.__getitem__ if _PLAIN(piece) else self.others.__getitem__, self.words(piece.lower())))
        if RARE(piece):  # only the stretches that hold such characters take the long way
            out = []
            for chunk in self.spaces(" ", piece).split(" "):
                out += self._rare(chunk) if RARE(chunk) else self._words_of(chunk) if chunk else []
            return out
        # lower case is taken character by character, so a final sigma has no form of its own
        plain = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
        known, others = self.known, self.others
        return [known[w] if w.isascii() else others[w] for w in self.words(plain)]

    def encode(self, text: str) -> tuple[int, str, str]:
        """(number of ids, decimal ids joined by spaces, decoded text)."""
        self.known.turn()
        self.others.turn()
        if len(self.pairs) > 4 * KEPT_WORDS:
            self.pairs.clear()
        found: list[tuple[str, str]] = []
        for piece in self.stops(text) if "<|" in text else [text]:
            found += [(str(self.special[piece]), piece)] if piece in self.special else self._words_of(piece)
        if not found:
            return 0, "", ""
        ids, tokens = zip(*found)
        joined = " ".join(ids)
        return joined.count(" ") + 1, joined, " ".join(tokens)


def encode_documents(docs: DataFrame, tokenizer: str, with_text: bool = False) -> DataFrame:
    """Per document: id count and the digests of its ids and of the decoded text; ``with_text`` adds both as strings."""
    def run(batches):
        encoder = worker_cache(f"bpe_{zlib.crc32(tokenizer.encode())}", lambda: PrefixEncoder(tokenizer))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                n, ids, decoded = encoder.encode(text.as_py() or "")
                rows.append((n, digest(ids), digest(decoded), *((ids, decoded) if with_text else ())))
            columns = list(zip(*rows)) or [()] * (5 if with_text else 3)
            kinds = [pa.int64(), *[pa.string()] * 4]
            names = ["n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(columns, kinds)]], ["doc_id", *names[:len(columns)]])

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids string, decoded string" if with_text else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
