"""Kernels against plain re-statements of what they compute."""

import math

import numpy as np
import pytest

from streakframe.kernels import regions, stats, streaks
from streakframe.kernels.structure import Structure


def plain_robust_mean(x, r0, r1, n_iter, lm):
    j0, j1 = int(r0 * len(x)), int(r1 * len(x))
    mean = float(np.median(x))
    for _ in range(n_iter):
        order = sorted(range(len(x)), key=lambda k: ((x[k] - mean) ** 2, k))
        chosen = order[j0:j1] or [order[j0]]
        mean = sum(x[k] for k in chosen) / len(chosen)
    pairs = sorted((((x[k] - mean) ** 2, k) for k in range(len(x))))
    total, kept = 0.0, []
    for j, (e, k) in enumerate(pairs):
        total += e
        if lm * total < j * e:
            break
        kept.append((e, x[k]))
    return sum(v for _, v in kept) / len(kept), math.sqrt(sum(e for e, _ in kept) / len(kept))


@pytest.mark.parametrize(("r0", "r1", "n_iter"), [(0.5, 0.9, 5), (0.0, 0.5, 12), (0.0, 0.5, 0), (0.3, 0.3, 2)])
def test_robust_mean(r0, r1, n_iter):
    draw = np.random.default_rng(42)
    x = np.concatenate([draw.random((10, 200)), draw.uniform(0, 50, (10, 4))], axis=1)
    mean, std = stats.robust_mean(x, r0, r1, n_iter, 9.0)
    for row, m, s in zip(x.tolist(), mean, std, strict=True):
        assert (m, s) == pytest.approx(plain_robust_mean(row, r0, r1, n_iter, 9.0), rel=1e-9)


def test_robust_mean_of_equal_values_and_none():
    assert [float(v[0]) for v in stats.robust_mean(np.full((1, 6), 3.0))] == [3.0, 0.0]
    assert np.isnan(stats.robust_mean(np.zeros((2, 0)))[0]).all()


def test_robust_lsq_without_outliers_uses_all_points():
    draw = np.random.default_rng(1)
    w = draw.random((1, 60)) + 1
    y = 3 * w + draw.choice((-0.01, 0.01), (4, 60))
    expected = (y @ w.T)[:, 0] / (w**2).sum()
    assert stats.robust_lsq(w, y, 0.0, 1.0, 3, 9.0)[:, 0] == pytest.approx(expected)


def test_robust_lsq_with_outliers_and_empty_feature():
    draw = np.random.default_rng(2)
    w = np.stack([draw.random(300) + 1, np.zeros(300)])
    y = 2 * w[:1] + draw.normal(0, 0.01, (1, 300))
    y[0, :3] += 40
    fit = stats.robust_lsq(w, y, 0.5, 0.99, 3, 9.0)[0]
    assert fit[0] == pytest.approx(2, abs=0.01)
    assert fit[1] == 0


def test_structure():
    s = Structure((1, 1), 1)
    assert len(s) == 5 and s.rank == 2 and s.shape == (3, 3)
    assert s.to_array().astype(int).tolist() == [[0, 1, 0], [1, 1, 1], [0, 1, 0]]
    assert s.expand_dims(3).radii == (0, 1, 1) and s.expand_dims(3).squeeze() == s
    assert len(Structure((1, 1), 2)) == 9
    with pytest.raises(ValueError):
        s.expand_dims(1)


def flood(image, structure, npts):
    out, number = np.zeros(image.shape, int), 0
    for start in np.ndindex(image.shape):
        if image[start] == 0 or out[start] != 0:
            continue
        todo, own = [start], {start}
        while todo:
            at = todo.pop()
            for d in structure.neighbours:
                new = tuple(a + b for a, b in zip(at, d, strict=True))
                if all(0 <= a < n for a, n in zip(new, image.shape, strict=True)) and new not in own and image[new] == image[start]:
                    own.add(new)
                    todo.append(new)
        for at in own:
            out[at] = -1
        if len(own) >= npts:
            number += 1
            for at in own:
                out[at] = number
    return np.maximum(out, 0)


@pytest.mark.parametrize(("shape", "structure"), [((30, 31), Structure((2, 2), 2)), ((8, 9, 10), Structure((1, 1, 1), 1)), ((20, 20), Structure((1, 1), 2))])
@pytest.mark.parametrize("npts", [1, 3])
def test_label(shape, structure, npts):
    draw = np.random.default_rng(7)
    image = draw.integers(0, 3, shape) * (draw.random(shape) < 0.5)
    assert (regions.label(image, structure, npts) == flood(image, structure, npts)).all()


def test_label_checks_rank_and_takes_empty_images():
    with pytest.raises(ValueError):
        regions.label(np.ones((3, 3)), Structure((1,), 1))
    assert not regions.label(np.zeros((4, 4)), Structure((1, 1), 1)).any()


def test_dilation_and_mask():
    image = np.zeros((9, 9), bool)
    image[4, 4] = True
    cross = Structure((1, 1), 1)
    assert regions.dilate(image, cross).sum() == 5 and regions.dilate(image, cross, 2).sum() == 13
    mask = np.zeros((9, 9), bool)
    mask[4] = True
    assert regions.dilate(image, cross, 3, mask).sum() == 7


def test_moments_and_line():
    at = np.array([(y, x) for y in range(3) for x in range(9)])
    mass, centre, spread = regions.moments(at, np.ones(len(at)))
    assert mass == 27 and centre.tolist() == [1, 4]
    assert spread[1, 1] == pytest.approx(np.var(range(9))) and spread[0, 1] == pytest.approx(0)
    ends = regions.line_fit(at, np.ones(len(at)))
    assert ends[0, 1] > ends[1, 1] and ends[:, 0].tolist() == pytest.approx([1, 1])
    assert regions.moments(at, -np.ones(len(at)))[0] == 0


def test_log_binomial_tail():
    for n, k, p in ((10, 3, 0.2), (30, 29, 0.5), (5, 5, 0.9)):
        exact = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1))
        assert regions.log_binomial_tail(n, k, p) == pytest.approx(math.log(exact))
    assert regions.log_binomial_tail(5, 0, 0.1) == 0 and regions.log_binomial_tail(5, 6, 0.1) == -math.inf and regions.log_binomial_tail(5, 2, 1.0) == 0


def drawn(shape, segments, width=1.0):
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    points = np.stack([yy.ravel(), xx.ravel()], axis=1).astype(float)
    out = np.zeros(shape)
    for x0, y0, x1, y1 in segments:
        d = regions.distance(points, np.array([[y0, x0], [y1, x1]])).reshape(shape) / width
        out = np.maximum(out, np.where(d <= 1, 15 / 16 * (1 - d * d) ** 2, 0))
    return out


@pytest.fixture(scope="module")
def scene():
    draw = np.random.default_rng(42)
    segments = [(x, y, x + 12 * math.cos(a), y + 12 * math.sin(a)) for x, y, a in zip(draw.uniform(15, 85, 15), draw.uniform(15, 65, 15), draw.uniform(0, 2 * math.pi, 15), strict=True)]
    data = drawn((80, 100), segments) + 0.1 * draw.random((80, 100))
    return data[None], segments


def test_peaks_are_local_maxima_of_their_bins(scene):
    data, _ = scene
    labeled = data >= 0.4
    found = streaks.detect_peaks(data, labeled, 3, 0.4)
    assert found.shape == streaks.binned_shape(data.shape, 3)
    for place in np.ndindex(found.shape):
        part = (0, slice(3 * place[1], 3 * place[1] + 3), slice(3 * place[2], 3 * place[2] + 3))
        assert (found[place] == streaks.BAD) == (not labeled[part].any())
        if 0 <= found[place] < data.size:
            _, y, x = np.unravel_index(found[place], data.shape)
            assert y // 3 == place[1] and x // 3 == place[2] and data[0, y, x] > 0.4
            assert all(data[0, y, x] >= data[0, y + dy, x + dx] for dy, dx in ((0, 1), (1, 0), (0, -1), (-1, 0)))


def test_streaks(scene):
    data, segments = scene
    structure = Structure((0, 2, 2), 2)
    labeled = regions.label(data >= 0.4, Structure((0, 1, 1), 1), 5) > 0
    peaks = streaks.peak_labels(streaks.detect_peaks(data, labeled, 2, 0.4), data, 2)
    bright = [data.flat[p] for p in peaks.at]
    assert bright == sorted(bright, reverse=True) and peaks.keep_best(0.5).n_seeds == peaks.n_seeds // 2
    finder = streaks.Finder(data, peaks, structure, 0.4)
    finder.fit_linelets()
    assert len(finder.linelets) == len(peaks.at) >= peaks.n_seeds
    found = finder.detect(0.8, 0)
    for members in found:
        points = np.concatenate([finder.linelets[m] for m in members])
        assert len(set(members)) == len(members)
        assert finder.n_signal(members) <= len(finder.pixels(members))
        assert np.isfinite(finder.line(members)).all() and len(points) == 2 * len(members)
    ranks = streaks.ranking([finder.n_signal(s) for s in found])
    assert sorted(ranks) == list(range(len(found)))
    painted = streaks.paint(finder, found, ranks)
    best = int(np.argmin(ranks))
    assert (painted.flat[finder.pixels(found[best])] == 1).all()


def test_most_lines_are_found(scene):
    data, segments = scene
    rows = streaks.find(data, Structure((0, 2, 2), 2), 0.4, 5, 1.0, 1, 1.0, Structure((0, 1, 1), 1))
    near = 0
    for x0, y0, x1, y1 in segments:
        middle = np.array([[(y0 + y1) / 2, (x0 + x1) / 2]])
        near += min(float(regions.distance(middle, np.array([[r[2], r[1]], [r[4], r[3]]]))[0]) for r in rows) < 1.5
    assert near >= 12 and (rows[:, 6] >= 1.0).all()


def test_no_streaks_in_an_empty_frame():
    assert streaks.find(np.zeros((1, 10, 10)), Structure((0, 1, 1), 1), 0.5, 1, 1.0, 0, 0.0, Structure((0, 1, 1), 1)).shape == (0, 7)
