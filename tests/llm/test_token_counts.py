import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from colloquy.llm import token_counts as tc

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LIBRARY = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["one line", "two\nlines here\n", "\n\n\n", "a\n\n\nb  \n c", "é😀\nü\n\nß x", "", None,
         "no end\r\nodd \n"]


def brute(text, starts, rule):
    """Tokens per section from the library's offsets, in bytes."""
    data = text.encode()
    begins = sorted({0} | {len(text[:s].encode()) for s in starts if 0 < s < len(text)})
    borders = begins + [len(data)]
    counts = [0] * len(begins)
    at = 0
    tokenizer = Tokenizer.from_file(LIBRARY)
    known = tokenizer.get_vocab(with_added_tokens=False)
    sizes = {i: len(t) for t, i in known.items()}  # a letter stands for a byte
    for i in tokenizer.encode(text, add_special_tokens=False).ids:
        a, b = at, at + sizes[i]
        parts = [max(0, min(b, e) - max(a, s)) for s, e in zip(borders, borders[1:])]
        inside = [n for n, p in enumerate(parts) if p]
        best = {"first": inside[0], "last": inside[-1], "most": parts.index(max(parts))}
        counts[best[rule]] += 1
        at = b
    assert at == len(data)
    return counts


@pytest.mark.parametrize("rule", tc.RULES)
def test_lines(docs, rule):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0])]
    got = {}
    for r in tc.section_tokens(docs(rows), RANKS, "doc_id", rule=rule).collect():
        got.setdefault(r.doc_id, {})[r.section] = (r.first_char, r.n_chars, r.n_tokens)
    for i, text in enumerate(TEXTS):
        text = text or ""
        lines = text.splitlines(keepends=True) if "\r" not in text else [
            part + "\n" for part in text.split("\n")[:-1]]
        starts = [sum(map(len, lines[:n])) for n in range(len(lines))]
        counts = brute(text, starts, rule)
        found = [got[i][n] for n in sorted(got[i])]
        assert [f[2] for f in found] == counts, text
        assert [f[1] for f in found] == ([len(x) for x in lines] or [0])


@pytest.mark.parametrize("rule", tc.RULES)
def test_sections_that_cut_tokens(docs, rule):
    text = "internationalization of 😀😀 words"
    starts = [3, 8, 25, 26, 999, None]
    table = docs([(1, text)]).withColumn("at", F.lit("3,8,25,26,999").substr(1, 99))
    table = table.withColumn("at", F.concat(F.split("at", ",").cast("array<bigint>"),
                                            F.array(F.lit(None).cast("bigint"))))
    got = tc.section_tokens(table, RANKS, "doc_id", starts="at", rule=rule).orderBy("section")
    counts = [r.n_tokens for r in got.collect()]
    assert counts == brute(text, [s for s in starts if s], rule)


def test_many_sections_come_in_parts(docs, monkeypatch):
    monkeypatch.setattr(tc, "OUT_ROWS", 4)
    rows = [(i, "x\n" * 7) for i in range(5)]
    got = tc.section_tokens(docs(rows), RANKS, "doc_id", "kept").collect()
    assert len(got) == 35 and {r.kept for r in got} == {f"kept-{i}" for i in range(5)}


def test_empty_table_and_wrong_rule(docs):
    assert tc.section_tokens(docs([]), RANKS, "doc_id").count() == 0
    with pytest.raises(ValueError, match="rule"):
        tc.section_tokens(docs([]), RANKS, "doc_id", rule="half")
