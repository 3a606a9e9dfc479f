import math
import random
from collections import Counter

import pytest

from gleanset.llm.grams import BUCKETS
from gleanset.llm.language import EVIDENCE, STRENGTH, declared_language, identify, language_models, places, visible_text

WORDS = {
    "de": "der die und nicht eine straße über haus keit ung schön".split(),
    "en": "the of and this with house thing street over nice".split(),
    "fr": "le la et pas une rue élève maison tion dessus beau".split(),
}
PAGES = "page_id long, url string, html string, lang string, probability string"


def text(lang, seed, n=60):
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def models(spark):
    rows = [(text(lang, i, 80), lang) for lang in WORDS for i in range(20)] + [(None, "en"), ("x", None)]
    return language_models(spark.createDataFrame(rows, "text string, lang string"))


def test_parts_of_a_page():
    page = '<!DOCTYPE html><html data-x="1" lang="DE-at"><script>var a="the of";</script><!-- the --><p>schön &amp; gut</p></html>'
    assert declared_language(page) == "de"
    assert visible_text(page).split() == ["schön", "&", "gut"]
    assert declared_language("<html><body lang=fr>") is None
    assert places("https://Blog.example.co.uk:8080/x") == ("blog.example.co.uk", "co.uk", "uk")
    assert places("no address") == places(None) == places("http://[broken") == (None, None, None)


def test_fusion(spark, models):
    rows = []
    for i in range(60):
        lang = ("de", "en", "fr")[i % 3]
        said = lang if i % 5 else "en"  # a default that nobody changed
        rows.append((i, f"http://www.{lang}{i % 2}.example/{i}", f'<html lang="{said}"><p>{text(lang, 100 + i)}</p></html>', "", ""))
    rows += [
        (100, "http://www.fr1.example/x", "<html><p></p></html>", "", ""), (101, "http://www.de0.example/y", None, "", ""),
        (102, None, '<html lang="en"></html>', "", ""), (103, None, None, "", ""), (104, "http://www.fr1.example/z", '<html lang="zz"><p>le la et</p></html>', "", ""),
        (105, "http://new.example", f'<html lang="fr"><p>{text("de", 7)}</p></html>', "", ""), (None, "http://www.en0.example", "", "", ""),
    ]
    rows.append(rows[0])
    got = identify(spark.createDataFrame(rows, PAGES), *models).collect()
    assert len(got) == len(rows)
    by_id = {r["page_id"]: r for r in got}
    assert all(by_id[i]["lang"] == ("de", "en", "fr")[i % 3] for i in range(60))
    assert by_id[100]["lang"] == "fr" and by_id[101]["lang"] == "de" and by_id[None]["lang"] == "en"
    assert by_id[102]["lang"] == "en"  # nothing but a declaration
    assert by_id[104]["lang"] == "fr" and by_id[104]["declared"] == "other"
    assert by_id[105]["lang"] == "de"  # plain text outweighs a wrong declaration
    assert all(0 < r["probability"] <= 1 for r in got)


def test_host_priors_count_other_pages_only(spark, models):
    rows = [(1, "http://lonely.example", "", "", "")] + [(10 + i, f"http://other{i}.example", f"<p>{text('fr', i)}</p>", "", "") for i in range(9)]
    got = {r["page_id"]: r for r in identify(spark.createDataFrame(rows, PAGES), *models).collect()}
    assert got[1]["lang"] == "fr"  # from its suffix


def test_empty_tables(spark, models):
    none = spark.createDataFrame([], PAGES)
    assert identify(none, *models).count() == 0
    names, shares = language_models(spark.createDataFrame([], "text string, lang string"))
    assert names == []
    page = spark.createDataFrame([(1, "http://a.b", "<p>x</p>", "", "")], PAGES)
    assert [tuple(r) for r in identify(page, names, shares).collect()] == [(1, None, None, None, None)]


def softmax(odds):
    top = max(odds.values())
    chances = {k: math.exp(v - top) for k, v in odds.items()}
    return {k: v / sum(chances.values()) for k, v in chances.items()}


def test_posterior_by_hand(spark):
    """Models, trust in declarations, smoothed priors and the fused chance, each worked out in plain Python."""
    docs = [(text(lang, i, 40), lang) for lang in WORDS for i in range(6)] + [(None, "en"), ("x y z w", None)]
    names, shares = language_models(spark.createDataFrame(docs, "text string, lang string"))
    def grams(t):
        raw = t.encode()
        return [(int.from_bytes(raw[i:i + 4], "little") * 2654435761 % 2**32) >> 16 for i in range(len(raw) - 3)]
    counts = {n: Counter() for n in names}
    for t, lang in docs:
        if t is not None and lang is not None:
            counts[lang].update(grams(t))
    def share(lang, b):
        return math.log((counts[lang][b] + 0.5) / (sum(counts[lang].values()) + 0.5 * BUCKETS))
    pages = []
    for i in range(80):
        pick = random.Random(i)
        lang = pick.choice(names)
        words = " ".join(pick.choice(WORDS[lang if pick.random() < 0.6 else pick.choice(names)]) for _ in range(pick.randint(0, 5)))
        said = pick.choice([f' lang="{lang}"', ' lang="en"', ' lang="xx"', ""])
        host = pick.choice([f"http://{lang}.big.org/", f"http://www{i % 4}.{lang}.net/", "http://hot.big.org/", None])
        pages.append((i, host, f"<html{said}><p>{words}</p></html>", "", ""))
    pages += [(90, None, None, "", ""), (91, "http://hot.big.org/", "", "", "")]
    seen = {}
    for i, url, page, *_ in pages:
        found, said = grams(visible_text(page or "")), declared_language(page or "")
        weight = min(len(found), EVIDENCE) / max(1, len(found))
        seen[i] = ({n: weight * sum(share(n, b) for b in found) for n in names}, said if said is None or said in names else "other", places(url))
    trust, total = {}, Counter()
    for odds, said, _ in seen.values():
        trust.setdefault(said, Counter()).update(softmax(odds))
        total.update(softmax(odds))
    odds = {i: {n: o[n] + math.log((trust[said][n] + 1) / (total[n] + 1 + len(names) + 2)) for n in names} for i, (o, said, _) in seen.items()}
    own = {i: softmax(o) for i, o in odds.items()}
    sums = {}
    for i, (_, _, where) in seen.items():
        sums.setdefault("all", Counter()).update(own[i])
        for level, name in zip(("host", "domain", "suffix"), where, strict=True):
            if name is not None:
                sums.setdefault((level, name), Counter()).update(own[i])
    got = {r["page_id"]: r for r in identify(spark.createDataFrame(pages, PAGES).repartition(3), names, shares).collect()}
    assert set(got) == set(seen)
    for i, (_, said, (host, domain, suffix)) in seen.items():
        prior = {n: max(sums["all"][n] - own[i][n], 0) + 1 for n in names}
        prior = {n: p / sum(prior.values()) for n, p in prior.items()}
        for place in (("suffix", suffix), ("domain", domain), ("host", host)):
            others = {n: max(sums[place][n] - own[i][n], 0) if place in sums else 0 for n in names}
            prior = {n: (others[n] + STRENGTH * prior[n]) / (sum(others.values()) + STRENGTH) for n in names}
        final = softmax({n: odds[i][n] + math.log(prior[n]) for n in names})
        best = max(names, key=lambda n: final[n])
        assert got[i]["declared"] == said and got[i]["lang"] == best
        assert got[i]["probability"] == pytest.approx(final[best], abs=1e-4)
    assert len({r["lang"] for r in got.values()}) == 3 and min(r["probability"] for r in got.values()) < 0.9
