import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp

from tessella.operators import kernels as K

masks = hnp.arrays(bool, hnp.array_shapes(min_dims=2, max_dims=2, min_side=3, max_side=12))


def block(h, w, y0, y1, x0, x1, value=1.0):
    a = np.zeros((h, w))
    a[y0:y1, x0:x1] = value
    return a


def test_profile_counts_effective_components():
    m = block(40, 40, 5, 25, 5, 25) + block(40, 40, 30, 32, 30, 32) + block(40, 40, 35, 37, 2, 4)
    p = K.component_profile(m > 0, 1, 5)
    assert (p["count"], p["effective"]) == (3, 1)
    assert p["top_k_mass"] == pytest.approx(400 / 408) and p["extra_mass"] == pytest.approx(8 / 408)
    assert K.component_profile(np.zeros((4, 4), bool), 0)["top_k_mass"] == 1.0
    with pytest.raises(ValueError):
        K.component_profile(m > 0, -1)


def test_quantised_half_is_foreground():
    assert K.quantised(np.array([0.499, 0.5, 0.501])).tolist() == [False, True, True]


def test_localise_without_cores_is_low():
    f = K.localise(np.zeros((24, 32)), np.ones((8, 6, 8)))
    assert f["route"] == "low" and f["reliability"] == 0
    c = block(24, 32, 6, 18, 8, 24)
    one = block(6, 8, 1, 5, 2, 6)
    g = K.localise(c, np.stack([one, 1 - one, *[np.zeros((6, 8))] * 6]))
    assert 0 < g["reliability"] <= 1 and all(0 <= v <= 1 for v in g["components"].values())
    with pytest.raises(ValueError):
        K.localise(c, np.ones((8, 6, 8)), temperature=0)


def test_prompts_by_route():
    c = block(30, 40, 5, 10, 10, 20)
    assert K.prompts(c, c, "low") == []
    high = K.prompts(c, c, "high")
    assert [p["name"] for p in high] == ["point_only", "weak_box"] and high[1]["box"] == (8, 3, 21, 11)
    assert [p["name"] for p in K.prompts(c, c, "medium")] == ["point_only", "weak_box", "consensus_points"]
    with pytest.raises(ValueError):
        K.prompts(c, c, "other")


def fused(quality):
    c = block(64, 64, 16, 48, 16, 48)
    m = block(64, 64, 14, 50, 14, 50) > 0
    limits = K.constraint(c, c, "high")
    x = {"prompt": "a", "index": 0, "mask": m, "quality": quality}
    rgb = np.random.default_rng(0).integers(0, 255, (64, 64, 3))
    return c, limits, K.fuse(x, [x], c, c, rgb, limits)


def test_fusion_changes_the_band_alone():
    c, limits, out = fused(0.8)
    same = ~limits["band"] | limits["core"] | limits["rest"]
    assert np.array_equal(out["refined"][same], c[same])
    c, _, none = fused(0.0)
    assert np.array_equal(none["refined"], c) and none["changed_ratio"] == 0


def test_islands_without_support_go():
    c = block(48, 64, 14, 34, 16, 40)
    m = (c + block(48, 64, 3, 9, 52, 59)) > 0
    out = K.clean_islands(m, c, c)
    assert out["risk"] and out["after"] == 1 and np.array_equal(out["mask"], c > 0)


def test_backbone_spans_a_bridge():
    c = block(40, 72, 10, 30, 5, 25) + block(40, 72, 10, 30, 47, 67) + block(40, 72, 19, 21, 25, 47)
    core = (block(40, 72, 14, 26, 9, 21) + block(40, 72, 14, 26, 51, 63)) > 0
    b = K.backbone(c > 0, core)
    assert b[19:21, 25:47].any(0).all() and not (b & ~(c > 0)).any() and K.components(b)[1] == 1
    assert not K.backbone(c > 0, np.zeros_like(core)).any()


def test_growth_falls_back_to_the_coarse_map():
    c = block(80, 80, 30, 50, 30, 50)
    m = c > 0
    for y, x in ((4, 4), (4, 66), (66, 4)):
        m = m | (block(80, 80, y, y + 8, x, x + 8) > 0)
    s = np.where(m, 1.0, 0.0)
    x = {"prompt": "a", "index": 0, "mask": m, "quality": 1.0}
    limits = {"band": np.ones_like(m), "core": np.zeros_like(m), "rest": np.zeros_like(m), "radius": 2}
    out = K.calibrate(x, [x], c, s, np.repeat((s * 255)[:, :, None], 3, 2), limits)
    assert out["fallback"] == "excess_effective_component_growth" and np.array_equal(out["fusion"]["refined"], c)
    none = K.calibrate(None, [], c, s, np.zeros((80, 80, 3)), limits)
    assert none["fallback"] == "no_selected_candidate" and np.array_equal(none["fusion"]["refined"], c)


def test_boundary_iou_falls_with_a_shift():
    a, b = block(64, 64, 16, 48, 16, 48) > 0, block(64, 64, 20, 52, 20, 52) > 0
    assert K.boundary_iou(a, a, 2) == 1.0 > K.boundary_iou(a, b, 2)
    with pytest.raises(ValueError):
        K.inner_boundary(a, 0)


def test_inner_boundary_counts_the_edge_and_the_gradient_does_not():
    full = np.ones((5, 5), bool)
    assert K.inner_boundary(full, 1).sum() == 16 and not K.gradient_boundary(full).any()


def test_weighted_f_and_s_measure_of_equal_masks():
    g = block(20, 20, 4, 12, 4, 12) > 0
    assert K.weighted_f(g.astype(float), g) == pytest.approx(1) and K.s_measure(g.astype(float), g) == pytest.approx(1)
    assert K.weighted_f(g.astype(float), np.zeros_like(g)) == 0
    p, t = K.prepared(np.full((8, 8), 255), g[:8, :8])
    assert p.max() == 1.0


def test_codec_and_shapes():
    m = block(9, 11, 2, 7, 3, 8) > 0
    assert np.array_equal(K.unpack_mask(K.pack_mask(m), 9, 11), m)
    assert K.components(m)[1] == 1 and K.centroid(m) == (5.0, 4.0)
    a = np.arange(24.0).reshape(4, 6)
    assert np.array_equal(K.split_tiles(a, 2, 2)[0], a[:2, :3])
    assert np.array_equal(K.centre_crop(K.centre_pad(a, 8, 8), 4, 6), a)
    batch, valid = K.padded_batch([a, a[:2, :2]])
    assert batch.shape == (2, 4, 6) and valid[1].sum() == 4
    assert np.array_equal(K.merge_overlapping([a, a], [(0, 0), (0, 0)], 4, 6), a)


def test_resizing():
    a = np.arange(16.0).reshape(4, 4)
    assert np.allclose(K.resize_bilinear(a, 4, 4), a) and np.allclose(K.resize_bilinear(np.ones((3, 3)), 7, 5), 1)
    assert K.resize_bilinear(a, 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert np.array_equal(K.resize_nearest(a, 2, 2), a[::2, ::2])
    assert (K.resize_lanczos(np.full((50, 40), 200), 10, 10) == 200).all()


def test_control_masks():
    c = block(4, 4, 1, 3, 1, 3)
    hard, soft = K.control_masks(c, 8, 12)
    assert set(np.unique(hard)) <= {0, 255} and ((soft > 0) & (soft < 255)).any()


def test_specks_look_twice_and_strategies():
    m = (block(12, 12, 1, 7, 1, 7) + block(12, 12, 9, 10, 9, 10)) > 0
    assert not K.flip_specks(m)[9, 9] and K.flip_specks(m)[3, 3]
    assert K.look_twice(np.zeros((8, 8), bool), 0.5) == [(2, 2, 4, 4)]
    assert K.look_twice(m, 0.1) is None and len(K.look_twice(m, 0.9)) == 1
    c = block(12, 12, 1, 7, 1, 7) > 0
    assert np.array_equal(K.pick_mask([m, ~m], c, "best_iou"), m) and np.array_equal(K.pick_mask([m, ~m], c, "reverse"), ~m)
    assert np.array_equal(K.pick_mask([m], c, "union"), c) and np.array_equal(K.pick_mask([], c, "area"), c)
    assert np.array_equal(K.gated_label(m, c, 0.0, 0.0), K.gated_label(m, c, 0.0, 0.0))
    assert len(K.sampled_points(m, 5, 1)) == 5 and np.array_equal(K.sampled_points(m, 5, 1), K.sampled_points(m, 5, 1))


def test_edges():
    rgb = np.zeros((30, 30, 3))
    rgb[:, 15:] = 255
    half = np.zeros((30, 30), bool)
    half[:, 15:] = True
    assert K.edge_align(half, rgb) > 0.4 and K.edge_align(np.zeros((30, 30), bool), rgb) == 0
    assert K.edge_map(np.zeros((9, 9, 3))).max() == 0


@given(masks)
@settings(max_examples=60, deadline=None)
def test_components_agree_with_a_flood(m):
    seen, n = set(), 0
    for start in zip(*np.nonzero(m)):
        if start in seen:
            continue
        n += 1
        stack = [start]
        while stack:
            y, x = stack.pop()
            if (y, x) in seen or not (0 <= y < m.shape[0] and 0 <= x < m.shape[1]) or not m[y, x]:
                continue
            seen.add((y, x))
            stack += [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    assert K.components(m)[1] == n == K.components(m[::-1])[1] == K.components(m[:, ::-1])[1]


@given(masks)
@settings(max_examples=60, deadline=None)
def test_nearest_agrees_with_brute_force(m):
    d, index = K.nearest(m)
    t = np.argwhere(m)
    for y in range(m.shape[0]):
        for x in range(m.shape[1]):
            if len(t):
                q = ((t - [y, x]) ** 2).sum(1)
                assert d[y, x] == pytest.approx(np.sqrt(q.min())) and index[y, x] == t[q.argmin()] @ [m.shape[1], 1]
            else:
                assert np.isinf(d[y, x]) and index[y, x] == -1


@given(masks, st.integers(0, 3))
@settings(max_examples=60, deadline=None)
def test_morphology_is_dual_and_iou_is_symmetric(m, r):
    e = K.ellipse(r)
    assert np.array_equal(K.erode(m, e), ~K.dilate(~m, e)) and (K.dilate(m, e) | m == K.dilate(m, e)).all()
    other = np.roll(m, 1, 0)
    assert K.iou(m, other) == K.iou(other, m) and 0 <= K.iou(m, other) <= 1
    assert K.iou(m & False, m & False) == 1 and K.iou(m & False, m & False, 0.0) == 0


def test_f_and_e_curves_match_a_direct_count():
    rng = np.random.default_rng(5)
    p, g = rng.random((16, 16)), rng.random((16, 16)) > 0.6
    q = (p * 255).astype(np.uint8)
    _, curve = K.f_measure(p, g)
    for t in (0, 17, 128, 255):
        on = q >= t
        tp = (on & g).sum()
        pr, rc = tp / max(on.sum(), 1), tp / g.sum()
        assert curve[255 - t] == pytest.approx(1.3 * pr * rc / (0.3 * pr + rc) if tp else 0)
    assert K.auroc(p, g) == pytest.approx(np.mean([(a > b) + (a == b) / 2 for a in p[g] for b in p[~g]]))
    assert K.auroc(p, np.ones_like(g)) is None


def test_stacks_of_pairs_equal_single_pairs():
    rng = np.random.default_rng(8)
    for h, w in ((8, 8), (13, 21)):
        p, g = rng.random((2, 40, h, w)) < rng.uniform(0, 1, (2, 40, 1, 1))
        p[:3], g[2:5], p[5], g[6] = False, False, True, True
        g[7], p[8] = False, False
        g[7, 3, 2] = p[8, 0, 0] = True
        found = K.pair_metrics_stack(p, g, (1, 3))
        for i in range(40):
            want = K.pair_metrics(p[i], g[i], (1, 3))
            assert set(want) == set(found)
            for k, v in want.items():
                assert abs(found[k][i] - v) < 1e-9, (i, k)
        for i in range(40):
            d, at = K.nearest(g[i])
            assert np.allclose(K.nearest_stack(g)[0][i], d) and (K.nearest_stack(g)[1][i] == at).all()
