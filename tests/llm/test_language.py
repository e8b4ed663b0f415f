import numpy as np

from laneflow.llm import language
from tests.llm.conftest import kept_back

PARTS = {"xx": "the and ing tion er st", "yy": "le une eau que é ç", "zz": "ung sch heit ü ß ein"}


def corpus(words):
    rows = []
    for k, (lang, parts) in enumerate(PARTS.items()):
        w = words(k, parts)
        rows += [(1000 * k + i, w.text(w.random.randint(5, 60)), lang) for i in range(60)]
    return rows


def test_held_out_accuracy_and_edges(documents, words):
    rows = corpus(words)
    extra = [(9000, None, "xx"), (9001, "", "xx"), (9002, "123 %% \n 45", "xx"), (9003, PARTS["zz"] * 4000, None),
             (9004, "日本語の文章です", "xx"), (None, rows[0][1], None), (0, rows[0][1], "xx")]
    docs = documents(rows + extra, extra=("score", "lang_pred", "u"))
    filters = language.learn(docs, least_docs=2)
    assert set(filters.languages) == set(PARTS)
    found = language.identify(docs, filters).collect()
    assert len(found) == len(rows) + len(extra)
    by_id = {r["doc_id"]: r for r in found}
    held = [r for r in rows if kept_back(r[0])]
    assert len(held) > 20
    assert sum(by_id[r[0]]["lang_pred"] == r[2] for r in held) >= 0.97 * len(held)
    assert [by_id[i]["lang_pred"] for i in (9000, 9001, 9002, 9003)] == ["und", "und", "und", "zz"]
    assert by_id[9004]["lang_pred"] in PARTS and by_id[None]["lang_pred"] == "xx"
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_rows_and_null_languages_teach_nothing(documents, words):
    held = next(i for i in range(100) if kept_back(i))
    docs = documents([(held, words(1).text(50), "xx"), (held + 1000, "abc def", None)])
    filters = language.learn(docs, least_docs=1)
    assert filters.languages == []
    assert {r["lang_pred"] for r in language.identify(docs, filters).collect()} == {"und"}
    assert language.identify(documents([]), filters).collect() == []


def test_filters_give_all_languages_of_a_gram():
    draw = np.random.default_rng(0)
    grams = draw.integers(0, 2**63, size=3000, dtype=np.uint64)
    known = {f"l{i:03d}": grams[i * 20 : i * 20 + 500] for i in range(100)}
    filters = language.build(known, 16, 2, (3,))
    assert filters.slots.shape[1] == 2
    for name, own in known.items():
        hits = language.count_hits(filters, own)
        assert hits[filters.languages.index(name)] >= 499.5
        other = draw.integers(0, 2**63, size=4000, dtype=np.uint64)
    assert language.count_hits(filters, other).max() < 60  # corrected for false positives


def test_grams_stay_within_words():
    one = set(language.ngram_hashes("ab cd", (3,)).tolist())
    assert one == set(language.ngram_hashes("CD, 12 (ab)", (3,)).tolist())
    assert len(one) == 4
    assert len(language.ngram_hashes("1 2 %", (3, 4))) == 0


def test_no_language_with_a_document_to_learn_from_is_lost(documents, words):
    ids = [i for i in range(400) if not kept_back(i)]
    rows = [(ids[i], words(i, "the and ing").text(20), "xx") for i in range(8)]
    rows += [(ids[20], words(50, "ung sch heit").text(30), "yy")]
    rows += [(ids[30], words(60, "eau que le").text(30_000), "long")]  # longer than a window
    rows += [(ids[40 + i], "zum bo zam bim bo", "copied") for i in range(200)]  # one text, many times
    rows += [(ids[240], "quok quak quik", "copied")]
    learned = language.learn(documents(rows), longest=5000)
    assert set(learned.languages) == {"xx", "yy", "long", "copied"}
    asked = [(1, words(51, "ung sch heit").text(9)), (2, words(61, "eau que le").text(9)), (3, "quok quik"), (4, words(3, "the and ing").text(9))]
    found = {r["doc_id"]: r["lang_pred"] for r in language.identify(documents(asked), learned).collect()}
    assert found == {1: "yy", 2: "long", 3: "copied", 4: "xx"}


def test_decisions_follow_exact_gram_sets(words):
    """What the filters answer, against the sets of n-grams that they stand for."""
    sizes, own = (3, 4), {}
    for k, (lang, parts) in enumerate(PARTS.items()):
        texts = [words(100 * k + i, parts).text(40) for i in range(20)]
        own[lang] = np.unique(np.concatenate([language.ngram_hashes(t, sizes) for t in texts]))
    filters = language.build(own, 19, 2, sizes)
    for k, parts in enumerate([*PARTS.values(), "the une ung", "xylo phon"]):
        for i in range(20):
            text = words(900 + 50 * k + i, parts).text(15)
            grams = language.ngram_hashes(text, sizes)
            truth = np.array([np.isin(grams, own[lang]).sum() for lang in filters.languages], dtype=float)
            hits = language.count_hits(filters, grams)
            assert np.abs(hits - truth).max() <= 0.02 * len(grams) + 2
            lead = np.sort(truth)
            if lead[-1] - lead[-2] > 0.05 * len(grams) + 4:
                assert language.decide(filters, text)[0] == filters.languages[int(truth.argmax())]
