"""The trained models against plain versions: statistics, split search, decoding, and the point where the penalised loss is least."""

import math
from collections import Counter

import numpy as np
import pytest

from streakframe.llm import langid, quality, toxicity


def plain_statistics(text):
    """quality.statistics of one text, byte by byte and word by word."""
    data = text.encode()
    kinds = list(quality.GROUPS.values())
    out = [0.0] * (len(kinds) + len(quality.MARKS) + 14)
    if not data:
        return out
    for byte in data:
        for k, members in enumerate(kinds):
            out[k] += (byte in members) / len(data)
        if bytes([byte]) in quality.MARKS:
            out[len(kinds) + quality.MARKS.index(byte)] += 1 / len(data)
    words, lines = data.split(), [x for x in data.split(b"\n") if x]
    n, m = max(1, len(words)), max(1, len(lines))
    times, lined, bytes_ = Counter(words), Counter(lines), Counter(data)
    out[-14:] = [
        math.log(1 + len(data)), math.log(1 + len(words)), len(data) / n, max([0, *map(len, words)]), len(times) / n, max([0, *times.values()]) / n,
        len([w for w in times if times[w] == 1]) / n, math.log(1 + len(lines)), len(lined) / m, sum(len(x) * (lined[x] - 1) for x in lined) / len(data), len(words) / m,
        -sum(c / len(data) * math.log2(c / len(data)) for c in bytes_.values()), len([w for w in times if w.isupper()]) / max(1, len(times)),
        len([w for w in times if w[-1] < 128 and not chr(w[-1]).isalnum()]) / max(1, len(times)),
    ]
    return out


def walked(model, row):
    """The score of one row of statistics, tree by tree and node by node."""
    row, margin = np.array(row, np.float32), model.base
    for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
        node = 0
        for _ in range(model.depth):
            node = 2 * node + 1 + int(row[f[node]] > c[node])
        margin += leaf[node - (2**model.depth - 1)]
    return 1 / (1 + math.exp(-margin))


def plain_score(model, text):
    """toxicity's score of one text: the weights of its distinct words' features."""
    words = toxicity.words_of(text)
    margin = model.intercept + math.fsum(model.weight.get(f, 0.0) for w in sorted(words) for f in toxicity.features_of(w))
    return 1 / (1 + math.exp(-max(-40, min(40, margin))))


@pytest.mark.parametrize("text", ["", "a", "Plain words, and more words.\nTwo lines\n\nTwo lines\n", "ÄÖ über 123 $$ {x} \t END END", "\x01\x7f  "])
def test_statistics_of_a_text(text):
    assert np.allclose(quality.statistics([text.encode()])[0], plain_statistics(text), rtol=1e-5, atol=1e-6)


def test_first_split_is_the_best_of_all():
    draw = np.random.default_rng(4)
    x = draw.normal(size=(300, 4)).astype(np.float32)
    y = (x[:, 1] + 0.4 * draw.normal(size=300) > 0.2).astype(float)
    model = quality.fit(x, y, trees=1, depth=1, bins=32)
    base = math.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    p = 1 / (1 + math.exp(-base))
    best, at = 0.0, None
    for k in range(4):
        for cut in np.unique(np.quantile(x[:, k], np.linspace(0, 1, 32)[1:-1])):
            left = x[:, k] <= cut
            gain = 0.0
            for side, sign in ((left, 1), (~left, 1), (np.ones(300, bool), -1)):
                g, h = float((p - y[side]).sum()), float(side.sum() * p * (1 - p))
                if h < 1:
                    gain = -math.inf
                gain += sign * g * g / (h + 1)
            if gain > best + 1e-9:
                best, at = gain, (k, cut)
    assert (model.feature[0, 0], model.cut[0, 0]) == (at[0], pytest.approx(at[1]))
    left = x[:, at[0]] <= at[1]
    for k, side in enumerate((left, ~left)):
        assert model.leaf[0, k] == pytest.approx(-0.15 * (p - y[side]).sum() / (side.sum() * p * (1 - p) + 1))


def test_decoding_takes_the_codeword_of_least_loss():
    words = {"de": "der die das und ist nicht ein", "en": "the of and that is not a", "fr": "le la les et est pas un", "es": "el los las y es no una"}
    model = langid.fit([t for t in words.values()] * 4, [k for k in words] * 4)
    texts = ["der und das", "la pas le", "that of the", "los y es", "und the"]
    margins = model.margins([t.encode() for t in texts])
    for text, margin, name, score, unsure in zip(texts, margins, *model.predict(texts), strict=True):
        loss = [sum(s * math.log(1 + math.exp(-m * c)) for m, c, s in zip(margin, word, model.say, strict=True)) for word in model.code]
        near = [math.exp(min(loss) - x) for x in loss]
        share = sorted((x / sum(near) for x in near), reverse=True)
        assert name == model.languages[loss.index(min(loss))] and score == pytest.approx(share[0]) and unsure == (share[0] - share[1] < 0.2), text
    # margins by hand: mean weight of the text's cells
    own = langid.cells(texts[0].encode())
    assert np.allclose(margins[0], np.mean([model.weight[c] for c in own], axis=0) + model.intercept, atol=1e-4)


def test_fit_ends_where_the_penalised_loss_is_least():
    """At the least point the slope of what is smooth is -l1 sign(w) for weights in use, and within l1 for the others."""
    draw = np.random.default_rng(6)
    n, m, l1, swap = 200, 12, 2e-3, 3.0
    vocabulary = np.arange(100, 100 + m, dtype=np.uint32)
    x = [np.sort(draw.choice(m, draw.integers(1, 6))).astype(np.int32) for _ in range(n)]
    y = np.array([float(draw.random() < (0.8 if (r == 2).any() else 0.2)) for r in x])
    named = np.array([k % 3 == 0 for k in range(n)])
    twins = [np.where(r == 5, 6, np.where(r == 6, 5, r)).astype(np.int32) if t else r[:0] for r, t in zip(x, named, strict=True)]
    model = toxicity.fit_kept(vocabulary, x, twins, named, y, l1=l1, swap=swap, steps=20_000)
    w = np.array([model.weight.get(int(f), 0.0) for f in vocabulary])
    cost = np.where(y > 0, 0.5 * n / y.sum(), 0.5 * n / (n - y.sum())) ** 0.5

    def smooth(w, b):
        z = np.array([b + sum(w[j] for j in r) for r in x])
        change = [sum(w[j] for j in t) - sum(w[j] for j in r) for r, t, k in zip(x, twins, named, strict=True) if k]
        return (cost * (np.logaddexp(0, z) - y * z)).sum() / n + swap / n * np.square(change).sum()

    slope = np.array([(smooth(w + d, model.intercept) - smooth(w - d, model.intercept)) / 2e-5 for d in np.eye(m) * 1e-5])
    used = w != 0
    assert used.any() and not used.all()
    assert np.allclose(slope[used], -l1 * np.sign(w[used]), atol=2e-6) and (np.abs(slope[~used]) <= l1 + 2e-6).all()
    assert abs(smooth(w, model.intercept + 1e-5) - smooth(w, model.intercept - 1e-5)) / 2e-5 < 2e-6
