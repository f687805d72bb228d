"""Words and term counts of toxicity scores."""

import random

import pytest

from trailmine.llm import toxicity


def test_term_counts_in_pieces(spark, monkeypatch):
    draw = random.Random(6)
    rows = [(" ".join(draw.choices(["stupid", "words", "wordsmith", "é", "x"], k=6)), i % 2)
            for i in range(50)] + [(None, 1), ("", 0)]
    table = spark.createDataFrame(rows, "text string, toxic int")
    whole = sorted(toxicity._term_counts(table).collect())
    monkeypatch.setattr(toxicity, "HELD_COUNTS", 3)
    assert sorted(toxicity._term_counts(table).collect()) == whole
    found = {(r["kind"], r["term"]): (r["bad"], r["good"], r["bad2"], r["good2"]) for r in whole}
    assert found["doc", ""] == (26, 26, 0, 0)
    split = [((text or "").split(), toxic) for text, toxic in rows]
    for term in ("stupid", "words", "é"):
        assert found["word", term] == tuple(
            sum(words.count(term) >= n and t == toxic for words, t in split)
            for n in (1, 2) for toxic in (1, 0))
    assert found["stem", "word"][0] == sum(
        t == 1 and any(w.startswith("word") for w in words) for words, t in split)



def test_clear_texts_are_not_searched_by_pattern(monkeypatch):
    """Also counts words as the pattern does, whatever is between them."""
    lexicon = toxicity.Lexicon(toxicity.Model(words={"stupid": 5.0}, stems={"idio": 4.0}))
    odd = "One-two, 3_b\x1cÉté—l’été İst “ΑΣ'Α ΑΣ” áb 日本 —"
    for text in (odd, odd + " stupid", odd + " Idiotic—STUPD"):
        hits, n_words = lexicon.hits(text)
        low = text.lower()
        assert n_words == len(toxicity._WORD.findall(low))
        assert [low[a:b] for a, b, *_ in hits] == [
            w for w in toxicity._WORD.findall(low) if lexicon.match(w)]
    monkeypatch.setattr(toxicity, "_WORD", None)
    assert lexicon.hits("Nothing, in_here 3 times") == ([], 4)
    with pytest.raises(AttributeError):
        lexicon.hits("a stupid word")
