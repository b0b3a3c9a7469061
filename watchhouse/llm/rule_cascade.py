"""Quality rules as a short-circuit cascade.

Every rule has a measured cost per text and rejects some share of the texts.  Both are estimated on a bounded sample; the
rules are then put in order, each time the one with the most rejections per cost among the texts still alive, and a rule
runs only on texts that no earlier rule rejected.  The order changes the work, never the verdict.

A null or empty text has no words and fails the base rules; texts of any length are measured as a whole; repeated rows are judged
each; an empty table gives no rows; other columns are ignored by ``judge`` and carried on by ``keep_good``.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 1000
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\r\x0b\x0c"
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20


class Measured:
    """A text with its measures; each is computed when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self.words = self.text.encode().split()  # bytes split at ASCII white space only
        self.n_words = len(self.words)

    @property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, BLANKS))

    @property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @property
    def lines(self) -> list[str]:
        """Lines with a word."""
        return [line for line in self.text.split("\n") if line.strip(BLANKS)]

    @property
    def n_dup_lines(self) -> int:
        lines = self.lines
        return len(lines) - len(set(lines))

    @property
    def n_repeat_words(self) -> int:
        """Words inside a five-word window that the text has at least twice."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], w[3:], w[4:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        covered, free = 0, 0
        for at, window in enumerate(windows):
            if times[window] > 1:
                covered += at + 5 - max(at, free)
                free = at + 5
        return covered


Rule = Callable[[Measured], bool]

# each says whether a text is to be rejected; all comparisons are between integers
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda m: m.n_words < MIN_WORDS,
    "repeated_words": lambda m: 100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words,
}
METHOD_RULES: dict[str, Rule] = {
    "symbols": lambda m: 100 * m.n_symbols > 10 * m.word_chars,
    "repeated_lines": lambda m: 100 * m.n_dup_lines > 50 * max(1, len(m.lines)),
    "word_length": lambda m: not 2 * m.n_words <= m.word_chars <= 30 * m.n_words,
    "capitals": lambda m: 2 * len(_CAPITAL(m.text)) > m.word_chars,
    "exclamations": lambda m: 2 * (m.text.count("!") + m.text.count("?")) > m.n_words,
}
_CAPITAL = re.compile("[A-Z]").findall


def plan_cascade(docs: DataFrame, rules: dict[str, Rule] | None = None, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in the order of rejections per cost, estimated on about ``sample_rows`` texts."""
    rules = {**BASE_RULES, **METHOD_RULES} if rules is None else rules
    total = docs.count()
    if total == 0:
        return list(rules)
    sample = docs.select("text").sample(min(1.0, sample_rows / total), seed=17)

    def measure(batches):
        spent, verdicts = Counter(), Counter()
        for batch in batches:
            for text in batch.column("text"):
                bits = 0
                for number, rule in enumerate(rules.values()):
                    began = time.perf_counter_ns()
                    bits |= rule(Measured(text.as_py())) << number
                    spent[number] += time.perf_counter_ns() - began
                verdicts[bits] += 1
        yield pa.RecordBatch.from_pydict({
            "what": ["cost"] * len(spent) + ["verdict"] * len(verdicts), "key": pa.array([*spent, *verdicts], pa.int64()),
            "value": pa.array([*spent.values(), *verdicts.values()], pa.int64())})

    # at most 2^rules + rules rows
    found = sample.mapInArrow(measure, "what string, key long, value long").groupBy("what", "key").agg(F.sum("value").alias("value")).collect()
    cost = {r.key: r.value for r in found if r.what == "cost"}
    alive = {r.key: r.value for r in found if r.what == "verdict"}
    order, left = [], set(range(len(rules)))
    while left:
        gain = lambda n: sum(v for bits, v in alive.items() if bits >> n & 1) / max(1, cost.get(n, 1))  # noqa: E731, B023
        best = max(sorted(left), key=lambda n: (gain(n), -cost.get(n, 0)))
        order.append(list(rules)[best])
        left.remove(best)
        alive = {bits: v for bits, v in alive.items() if not bits >> best & 1}
    return order


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Per document: the measures, base_failed and kept (no rule of the cascade rejects it)."""
    order = plan_cascade(docs) if order is None else order
    rules = {**BASE_RULES, **METHOD_RULES}

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                m = Measured(text.as_py())
                # the measures are asked for as columns, so the base rules are read off them
                repeats = m.n_repeat_words
                failed = m.n_words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * m.n_words
                kept = not failed and not any(rules[name](m) for name in order if name not in BASE_RULES)
                rows.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, repeats, failed, kept))
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.bool_()) for c in columns[5:]]],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"])

    schema = (f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
              "base_failed boolean, kept boolean")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns; each text meets the rules in cascade order until one rejects it."""
    order = plan_cascade(docs) if order is None else order
    rules = {**BASE_RULES, **METHOD_RULES}

    def run(batches):
        for batch in batches:
            good = []
            for text in batch.column("text"):
                m = Measured(text.as_py())
                good.append(not any(rules[name](m) for name in order))
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


# DuckDB SQL for ``judge`` over documents
ORACLE_SQL = r"""
WITH base AS (SELECT row_number() OVER () AS rn, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT rn, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM base),
win AS (SELECT rn, i, list_slice(ws, i, i + 4) AS five FROM (SELECT rn, ws, unnest(range(1, len(ws) - 3)) AS i FROM split)),
twice AS (SELECT rn, i FROM (SELECT rn, i, count(*) OVER (PARTITION BY rn, five) AS c FROM win) WHERE c > 1),
covered AS (SELECT rn, count(DISTINCT p) AS n FROM (SELECT rn, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY rn),
m AS (SELECT split.rn, doc_id, t, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
    FROM split LEFT JOIN covered ON covered.rn = split.rn),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    (NOT base_failed AND NOT 100 * n_symbols > 10 * word_chars AND NOT 100 * n_dup_lines > 50 * greatest(1, n_lines)
     AND word_chars BETWEEN 2 * n_words AND 30 * n_words
     AND NOT 2 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > word_chars
     AND NOT 2 * length(regexp_replace(t, '[^!?]', '', 'g')) > n_words) AS kept
FROM f
"""
