"""The fused posterior of languages, computed again row by row from the model and the counts of votes."""

import collections
import math
import random

import numpy as np

from lodesift.llm import language

PARTS = {"aa": "kra mok tul", "bb": "sil fen wey", "cc": "kra fen ostu"}


def _say(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang].split(), k=2)) for _ in range(n))


def _split(url):
    host = (url or "").split("://")[-1].split("/")[0].lower().removeprefix("www.")
    parts = host.split(".")
    return host, ".".join(parts[-2:]), parts[-1] if len(parts) > 1 else ""


def test_posterior_equals_plain_computation(spark):
    rng = random.Random(12)
    rows = []
    for i in range(240):
        lang = rng.choice("aa aa bb cc".split())
        url = f"https://{'www.' if i % 4 == 0 else ''}h{i % 9}.d{i % 4}.{rng.choice([lang, 'net'])}/x" if i % 7 else (None if i % 2 else "justhost")
        said = rng.choice([lang, lang, "aa", None, "zz"]) if i > 60 else lang
        rows.append((i, _say(rng, lang, rng.choice([1, 3, 40])), said, url))
    rows += [(500, None, "aa", "h1"), (501, "", None, None), (502, "##", "bb", "https://h1.d1.net/"), (503, "%%% $$$ &&& ***", "aa", "https://h1.d1.aa/")]
    df = spark.createDataFrame(rows, "i long, text string, lang string, url string")
    names, table = language.fit(df, languages=("aa", "bb", "cc"))
    full, n = np.hstack([table, np.full((language.GRAMS, 1), -np.log(language.GRAMS), np.float32)]), 3

    def lik(text):
        raw = (text or "").encode()
        if len(raw) < 3 or not raw.strip():
            return None
        return full[language._grams(raw)].sum(0, dtype=np.float64) * min(1.0, language.CERTAIN / (len(raw) - 2))

    scored = [(i, lik(t), said, *_split(url)) for i, t, said, url in rows]
    tally = {k: collections.Counter() for k in range(4)}
    for _, x, _, *keys in scored:
        if x is not None and (vote := int(x.argmax())) < n:
            for k, key in enumerate((*keys, "")):
                tally[k][key, vote] += 1
    whole = sum(tally[3].values())
    found = {r.i: r for r in language.identify(df, (names, table), "text", "lang", "url").collect()}
    for i, x, said, *keys in scored:
        if x is None:
            assert found[i].language == "und" and not found[i].kept
            continue
        vote, logits = int(x.argmax()), []
        count = lambda k, j: max(tally[k][keys[k], j] - (vote == j), 0)  # noqa: B023, E731
        for j, name in enumerate(names):
            base = (tally[3]["", j] + 1) / (whole + n)
            share = lambda k, up: (count(k, j) + 10 * up) / (sum(count(k, m) for m in range(n)) + 10)  # noqa: B023, E731
            prior = share(0, share(1, base))
            known = any(key == keys[2] for key, _ in tally[2]) and any(key == keys[0] for key, _ in tally[0])
            suffix = 0.5 * math.log(share(2, base) / base) if keys[2] and known else 0.0
            trusted = 0.9 if said == name else 0.05 if said in names else 1.0
            logits.append(x[j] + math.log(trusted) + math.log(prior * 0.99) + suffix)
        logits.append(x[n] + math.log(0.01) + (math.log(1 / 3) if said in names else 0.0))
        top = max(logits)
        want = ([*names, "und"][logits.index(top)], 1 / sum(math.exp(v - top) for v in logits))
        assert found[i].language == want[0] and math.isclose(found[i].probability, want[1], rel_tol=1e-6)
        assert found[i].kept == (want[0] != "und" and want[1] >= 0.5)


def test_noise_in_the_declared_column_makes_no_languages(spark):
    rng = random.Random(3)
    rows = [(_say(rng, lang, 30), lang) for lang in ("aa", "bb") for _ in range(600)] + [(_say(rng, "aa", 30), f"noise{i}") for i in range(300)]
    names, table = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert {"aa", "bb"} <= set(names) <= {"aa", "bb"} | {f"noise{i}" for i in range(300)} and table.shape == (language.GRAMS, len(names))
    rows += [(_say(rng, "bb", 30), "bb") for _ in range(800)]
    names, _ = language.fit(spark.createDataFrame(rows, "text string, lang string"))
    assert names == ("aa", "bb")
