import numpy as np

from tessella.operators import kernels as K
from tessella.operators import legacy as L


def square(n, a, b):
    m = np.zeros((n, n), bool)
    m[a:b, a:b] = True
    return m


def test_prompts():
    m = square(40, 10, 21)
    assert L.centroid_prompt(m)["positive"] == [(15, 15)] and L.centroid_prompt(np.zeros((4, 4), bool)) is None
    assert L.centroid_prompt(m, True)["box"] == (7, 7, 15, 15)
    out = L.outside_points((5, 5, 20, 20), 40, 40, 50, 1)
    assert len(out) == 50 and not any(5 <= x < 25 and 5 <= y < 25 for x, y in out.tolist())
    assert len(L.outside_points((0, 0, 40, 40), 40, 40, 5, 1)) == 0
    far = L.cautious_points(m, (5, 5, 25, 25), 10, 9.0, 2)
    assert len(far) == 10 and all(not m[y, x] and np.hypot(x - 15, y - 15) > 9 for x, y in far.tolist())


def test_choice():
    c = square(40, 10, 30)
    near, other, off = square(40, 10, 31), square(40, 14, 30), square(40, 0, 5)
    assert L.choose_mask([off, other, near], [1, 1, 0], c, [1, 0, 0]) == 2  # over 0.9
    assert L.choose_mask([off, other], [1, 0.1], c, [1, 0]) == 1
    assert L.choose_mask([off], [1], c, [1]) is None
    rgb = np.repeat(np.where(c, 255, 0)[:, :, None], 3, 2)
    out = L.refine([near, off], [0.9, 0.1], c, rgb)
    assert out["index"] == 0 and out["decision"] == "FUSION"
    assert L.refine([off], [0.9], c, rgb)["decision"] == "FALLBACK"


def test_smoothing_follows_the_image():
    rng = np.random.default_rng(0)
    c = square(48, 12, 36)
    rgb = np.repeat(np.where(c, 200, 40)[:, :, None], 3, 2)
    noisy = c ^ (rng.random(c.shape) < 0.1)
    s = L.smooth(noisy.astype(float), rgb)
    assert K.iou(s > 0.5, c) > 0.98 > K.iou(noisy, c)
    assert np.allclose(L.smooth(np.full(c.shape, 0.7), rgb), 0.7, atol=1e-3)
    out, used = L.snapped(noisy, rgb)
    assert used and K.iou(out, c) > 0.98
    kept, used = L.snapped(square(48, 0, 3), rgb)
    assert not used and np.array_equal(kept, square(48, 0, 3))
