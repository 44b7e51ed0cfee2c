"""Quality rules, line first: lines that fail are removed, then documents that lost too much are rejected.

A line fails by
  repetition   it has a word and equals an earlier line of the document,
  navigation   at least NAV_MIN separators, and one for every NAV_WORDS words or more,
  punctuation  more than SYMBOL_PERCENT of its word characters are symbols or exclamation marks,
  fragment     fewer than FRAGMENT_WORDS words and no closing punctuation,
  boilerplate  it holds one of the phrases in BOILERPLATE.
A document is kept if it passes the base rules (at least MIN_WORDS words, at most REPEAT_PERCENT of its
words in repeated three-word windows) and its removed lines hold at most LOST_PERCENT of its word characters.

Defined cases: null and empty texts have no words and fail the base; ties do not occur (no ranking); repeated rows
give repeated results; whole texts are read, however long; extra input columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from kernelfield.llm.common import WORD, lean, table

MIN_WORDS, REPEAT_PERCENT, LOST_PERCENT = 50, 50, 50
NAV_MIN, NAV_WORDS, SYMBOL_PERCENT, FRAGMENT_WORDS = 3, 3, 10, 3
SYMBOLS = "#*$%&|<>"
_SYMBOL = re.compile(r"[#*$%&|<>]")
_LOUD = re.compile(r"[#*$%&|<>!{}]")
_NAV = re.compile(r"[|»›]")
_CLOSED = re.compile(r"[.!?:;,\"')\]…。]$")
#: Fixed phrases, in the languages of the corpus; a dot stands for a letter with an accent.
PHRASES = {
    "en": "all rights reserved|privacy policy|cookie policy|uses cookies|terms of (use|service)|click here|sign up|log in to|subscribe to|enable javascript|lorem ipsum|licensed under|back to top|share this",
    "de": "alle rechte vorbehalten|datenschutzerkl.rung|verwendet cookies|nutzungsbedingungen|hier klicken|jetzt anmelden|newsletter abonnieren|javascript aktivieren|lizenziert unter|nach oben",
    "fr": "tous droits r.serv.s|politique de confidentialit.|utilise des cookies|conditions d.utilisation|cliquez ici|inscrivez-vous|abonnez-vous|activez javascript|sous licence|haut de page",
    "es": "todos los derechos reservados|pol.tica de privacidad|utiliza cookies|t.rminos de uso|haga clic|reg.strese|suscr.base|active javascript|bajo licencia|volver arriba",
}
BOILERPLATE = rf"(?i:{'|'.join(PHRASES.values())})"
_BOILER = re.compile(BOILERPLATE)
#: The longest plain part of each phrase: a text with none of these holds no phrase.
_PLAIN = [max(re.split(r"[.(|)]", x), key=len) for x in re.split(r"\|(?![^(]*\))", "|".join(PHRASES.values()))]


def may_hold_phrases(text: str) -> bool:
    low = text.lower()
    return any(x in low for x in _PLAIN) or "\u017f" in text  # which counts as an s

SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_lines_removed bigint, lost_chars bigint"


def line_fails(line: str, words: list[str], phrases: bool = True) -> bool:
    """Whether a line with words fails by itself (repetition apart); phrases: it may hold some."""
    n = len(words)
    navs = len(_NAV.findall(line))
    if navs >= NAV_MIN and navs * NAV_WORDS >= n:
        return True
    if 100 * len(_LOUD.findall(line)) > SYMBOL_PERCENT * sum(map(len, words)):
        return True
    if n < FRAGMENT_WORDS and not _CLOSED.search(words[-1]):
        return True
    return phrases and bool(_BOILER.search(line))


def repeat_words(words: list[str]) -> int:
    """Words that lie in a three-word window found at least twice."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    seen = Counter(windows)
    if len(seen) == len(windows):
        return 0
    total, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            total += i + 3 - max(i, upto)
            upto = i + 3
    return total


def judge(text: str | None) -> tuple[tuple, list[str]]:
    """The figures of SCHEMA and the lines that stay."""
    text = text or ""
    words = WORD.findall(text)
    word_chars = sum(map(len, words))
    earlier, stay, dup, removed, lost = set(), [], 0, 0, 0
    phrases = may_hold_phrases(text)
    for line in text.split("\n"):
        own = WORD.findall(line)
        if not own:
            stay.append(line)
            continue
        again = line in earlier
        dup += again
        earlier.add(line)
        if again or line_fails(line, own, phrases):
            removed += 1
            lost += sum(map(len, own))
        else:
            stay.append(line)
    again_words = repeat_words(words)
    failed = len(words) < MIN_WORDS or 100 * again_words > REPEAT_PERCENT * len(words)
    kept = not failed and 100 * lost <= LOST_PERCENT * word_chars
    return (len(words), word_chars, len(_SYMBOL.findall(text)), dup, again_words, failed, kept, removed, lost), stay


def quality_rules(docs: DataFrame, text: str = "text", key: str = "doc_id", cleaned: bool = False) -> DataFrame:
    """One row per row of docs: key and the figures of SCHEMA; with cleaned also clean_text, the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(s, 1024) for b in batches for s in range(0, b.num_rows, 1024)):
            rows, texts = [], []
            for value in batch.column(1).to_pylist():
                figures, stay = judge(value)
                rows.append(figures)
                if cleaned:
                    texts.append("\n".join(stay))
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.bool_() if x.endswith("boolean") else pa.int64() for x in SCHEMA.split(", ")]
            arrays = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            if cleaned:
                arrays, names = [*arrays, pa.array(texts, pa.string())], [*names, "clean_text"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [key, *names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(lean(run), f"`{key}` {kind}, {SCHEMA}" + ", clean_text string" * cleaned)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_W = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT r, unnest({_W.format('t')}) AS word, unnest(range(len({_W.format('t')}))) AS i FROM d),
g AS (SELECT r, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o AS tri FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM g WHERE tri IS NOT NULL) WHERE c > 1),
reps AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM again) GROUP BY r),
l0 AS (SELECT r, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
l1 AS (SELECT r, i, line, {_W.format('line')} AS ws, row_number() OVER (PARTITION BY r, line ORDER BY i) > 1 AS again FROM l0),
l2 AS (SELECT *, list_sum(list_transform(ws, lambda x: length(x))) AS chars, len(regexp_extract_all(line, '[|»›]')) AS navs,
       len(regexp_extract_all(line, '[#*$%&|<>!{{}}]')) AS loud FROM l1 WHERE len(ws) > 0),
l3 AS (SELECT r, chars, again, again OR (navs >= {NAV_MIN} AND navs * {NAV_WORDS} >= len(ws)) OR 100 * loud > {SYMBOL_PERCENT} * chars
       OR (len(ws) < {FRAGMENT_WORDS} AND NOT regexp_matches(ws[-1], '[.!?:;,"'')\]…。]$')) OR regexp_matches(line, '{BOILERPLATE}') AS bad FROM l2),
ls AS (SELECT r, count(*) FILTER (again) AS dup, count(*) FILTER (bad) AS removed, coalesce(sum(chars) FILTER (bad), 0) AS lost FROM l3 GROUP BY r),
f AS (SELECT doc_id, len({_W.format('t')}) AS n_words, coalesce(list_sum(list_transform({_W.format('t')}, lambda x: length(x))), 0) AS word_chars,
      len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(dup, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
      coalesce(removed, 0) AS n_lines_removed, coalesce(lost, 0) AS lost_chars FROM d LEFT JOIN ls USING (r) LEFT JOIN reps USING (r))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AND 100 * lost_chars <= {LOST_PERCENT} * word_chars AS kept,
  CAST(n_lines_removed AS BIGINT) AS n_lines_removed, CAST(lost_chars AS BIGINT) AS lost_chars
FROM f
"""
