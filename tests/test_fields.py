"""Field operators against literal results and numpy."""

import numpy as np
import pytest

from tensorfold.field import Field
from tensorfold.operators import pointwise as p
from tensorfold.operators import reduce as r
from tensorfold.operators import shape as sh
from tensorfold.operators import spectral as sp
from tensorfold.operators import stencil as st
from tensorfold.operators import tensor as t
from tensorfold.types import FieldType, SemanticError, downsample_output, result_type, upsample_input


@pytest.fixture(scope="module")
def of(spark):
    return lambda values, dims=0, kind="real": Field.of(spark, values, dims, kind)


def same(field, expected, tol=1e-6):
    got, expected = field.read(), np.asarray(expected)
    assert got.shape == expected.shape
    assert np.allclose(got, expected, atol=tol, equal_nan=True), (got, expected)


W = np.add.outer(np.arange(0, 40, 10), np.arange(5)).astype(float)


def test_types():
    s, v = FieldType((2, 3)), FieldType((2, 3), (4,))
    assert result_type(s, v) == v and result_type(FieldType(), v) == v
    assert result_type(s, s.with_(kind="complex")).kind == "complex"
    for a, b in ((FieldType((2,)), FieldType((3,))), (v, FieldType((2, 3), (5,)))):
        with pytest.raises(SemanticError):
            result_type(a, b)


@pytest.mark.parametrize("border, expected", [("clamp", [1.25, 2, 3, 3.75]), ("cyclic", [2, 2, 3, 3]), ("zero", [1, 2, 3, 2.75])])
def test_convolve_borders(of, border, expected):
    x, k = of([1.0, 2, 3, 4]), of([0.25, 0.5, 0.25])
    same(st.convolve(x, k, border), expected)
    same(st.convolve(x, Field.from_df(k.df(), k.type), border), expected)


def test_convolve_sizes_and_sampling(of):
    a, w = [1.0, 2, 3, 4], [1.0, 2, 3]
    x, k = of(a), of(w)
    for border, how in (("zero", "same"), ("full", "full"), ("valid", "valid")):
        same(st.convolve(x, k, border), np.convolve(a, w, how))
    same(st.cross_correlate(x, k, "valid"), np.correlate(a, w, "valid"))
    same(st.convolve(x, k, "zero", downsample_output(2)), np.convolve(a, w, "same")[::2])
    same(st.convolve(x, k, "zero", upsample_input(2)), np.convolve([1, 0, 2, 0, 3, 0, 4, 0], w, "same"))
    c = np.array([1 + 2j, 3 - 1j, 2j])
    same(st.convolve(of(c, kind="complex"), of(c[:1], kind="complex"), "full"), np.convolve(c, c[:1]))
    same(st.convolve_separable(of(W), k, k, "clamp"), st.convolve(of(W), sh.outer(k, k), "clamp").read())


def whole(field, expected):
    """Each point once, besides the values."""
    rows = field.df().collect()
    assert len(rows) == len({r[:3] for r in rows}) == field.type.points
    same(field, expected)


def test_convolutions_have_every_point(of):
    x, k = np.arange(1.0, 5), np.array([2.0, 0, 5])
    for up in (1, 2, 3):
        grown = np.zeros(4 * up)
        grown[::up] = x
        for border, how in (("zero", "same"), ("full", "full"), ("valid", "valid")):
            for w in (k[:1], k, k * [0, 0, 1]):
                whole(st.convolve(of(x), of(w), border, upsample_input(up)), np.convolve(grown, w, how))
                whole(st.convolve(of(x), Field.from_df(of(w).df(), FieldType(w.shape)), border, upsample_input(up)), np.convolve(grown, w, how))
    nan = np.array([[1, np.nan, 2]])
    whole(st.convolve(of(nan), of([[1.0]]), "zero", upsample_input(2)), [[1, 0, np.nan, 0, 2, 0], [0] * 6])


def test_targets_are_dealt_by_their_number(spark):
    f = Field.constant(spark, (1 << 20, 4), 1.0)
    wide = st.convolve(f, Field.of(spark, np.ones((3, 3))), "zero", upsample_input(2)).df()
    plan = wide._jdf.queryExecution().toString()
    assert "Join" not in plan and "REPARTITION_BY_NUM" in plan
    assert wide.where("row % 65536 = 1 and col = 1").select("v").distinct().collect() == [(4.0,)]


def test_frames(of):
    x, bank = of(np.ones((3, 3, 2)), 1), of(np.arange(4.0).reshape(1, 1, 4), 1)
    same(st.project_frame(x, bank), np.broadcast_to(np.arange(4.0), (3, 3, 4)))
    same(st.project_frame_block_reduce_sum(x, bank), np.broadcast_to([1.0, 5], (3, 3, 2)))


def test_neighbourhoods(of):
    same(st.median_filter(of([[1, 7, 5, 2], [-2, 0, 4, -9], [4, -7, 3, 7], [2, 1, 3, 5.0]])), [[1, 4, 4, 2], [1, 3, 3, 3], [1, 2, 3, 4], [2, 2, 3, 5]])
    n = of([[0, 1, 13, 15, 4], [10, 22, 12, 13, 14], [20, 20, 22, 20, 19], [30, 16, 19, 33, 34.0]])
    same(st.non_maximum_suppression(n), [[0, 0, 0, 15, 0], [0, 22, 0, 0, 0], [0, 0, 0, 0, 0], [30, 0, 0, 0, 34]])
    m = of([[1, 1, 0, 2, 3], [0, 5, 3, 1, 6], [1, 2, 0, 2, 0], [1, 1, 1, 2, 2], [3, 1, 4, 3, 1.0]])
    same(st.local_max(m, [[1, 1, 0], [1, 1, 0], [0, 0, 0]]), [[1, 1, 1, 2, 3], [1, 5, 5, 3, 6], [1, 5, 5, 3, 6], [1, 2, 2, 2, 2], [3, 3, 4, 4, 3]])
    x = of([[1, 1.1, 0, 2.1, 3.3], [0, 5, 3, 1.2, 6], [1, 2, 0, 2.1, 0], [1.1, 1.2, 1, 2, 2.3], [3, 1.1, 4, 3, 1]])
    rows = [[1, 1, 1, 1, 1], [0, 0, 0, 0, 0], [0, -1, -1, -1, -1], [1, 1, 1, 1, 0], [0, 0, 0, 0, 0]]
    cols = [[1, 0, 0, 1, 0], [1, 0, -1, 1, 0], [1, 0, -1, -1, 0], [0, 1, 0, 0, 0], [0, 1, 0, -1, -1]]
    same(st.local_max_position(x, [[1, 1, 0], [1, 1, 1], [0, 1, 1]]), np.dstack([rows, cols]))
    same(st.oriented_non_maximum_suppression(of(np.outer(np.eye(5)[2], np.ones(5))), of(np.full((5, 5), np.pi / 2))), np.outer(np.eye(5)[2], np.ones(5)))
    same(st.bilateral_filter(of(np.full((3, 3), 5.0)), np.ones((3, 3)), 1.0), np.full((3, 3), 5.0))


def test_gradients(of):
    g = of([[1, 7, 5], [-2, 0, 4], [4, -7, 3.0]])
    same(st.forward_gradient(g), np.dstack([[[-3, -7, 0], [6, -7, 0], [0, 0, 0]], [[6, -2, 0], [2, 4, 0], [0, 0, 0]]]))
    same(st.backward_gradient(g), np.dstack([[[0, 0, 0], [0, -7, -1], [0, -7, -1]], [[0, 0, 0], [0, 2, 4], [0, -11, 10]]]))
    row = of([[1, 2, 4.0]])
    domain = st.domain_transform_rows(row, 2, 1)
    same(domain, [[1, 4, 9]])
    same(st.domain_filter_rows(row, domain, 3.0), [[1.5, 1.5, 4]])


def test_warps(of):
    w = of(W)
    same(st.warp(w, of([-0.5, -0.5], 1)), [[5.5, 6.5, 7.5, 8.5, 9], [15.5, 16.5, 17.5, 18.5, 19], [25.5, 26.5, 27.5, 28.5, 29], [30.5, 31.5, 32.5, 33.5, 34]])
    same(st.warp(w, of([1.5, 0.5], 1)), [[0, 0.5, 1.5, 2.5, 3.5], [0, 0.5, 1.5, 2.5, 3.5], [5, 5.5, 6.5, 7.5, 8.5], [15, 15.5, 16.5, 17.5, 18.5]])
    same(st.warp(w, of([0, 1.0], 1), "zero"), [[0, 0, 1, 2, 3], [0, 10, 11, 12, 13], [0, 20, 21, 22, 23], [0, 30, 31, 32, 33]])
    same(st.subfield(w, of([0.5, 1.0], 1), (2, 2)), [[6, 7], [16, 17]])


def test_shapes(of):
    w = of(W)
    same(sh.flip(w), W[::-1, ::-1])
    same(sh.downsample(of([1.0, 2, 3, 4]), 2, 1), [2, 4])
    same(sh.upsample(of([[1.0, 7]]), 2), [[1, 0, 7, 0], [0, 0, 0, 0]])
    same(sh.supersample(w), np.kron(W, np.ones((2, 2))))
    same(sh.expand(of([[1, 2], [3, 4.0]]), "clamp", (4, 4)), [[1, 2, 2, 1], [3, 4, 4, 3], [3, 4, 4, 3], [1, 2, 2, 1]])
    same(sh.expand(of([[1, 2], [3, 4.0]]), "zero", (4, 4)), [[1, 2, 0, 0], [3, 4, 0, 0], [0] * 4, [0] * 4])
    same(sh.expand(of([11.0, 12, 13, 14, 15]), "cyclic", (9,)), [11, 12, 13, 14, 15, 11, 12, 14, 15])
    same(sh.shift(w, 1, -1), np.pad(W, ((1, 0), (0, 1)))[:4, 1:])
    same(sh.shift_cyclic(w, 1, -1), np.roll(W, (1, -1), (0, 1)))
    same(sh.transpose(w), W.T)
    same(sh.reshape(sh.reshape(w, (4,), (5,)), (20,), ()), W.ravel())
    same(sh.slice_point(w, of(9.7)), W[3])
    same(sh.stack(w, w + 1.0), np.stack([W, W + 1]))
    same(sh.push(w, sh.slice_at(w, 3)), np.concatenate([W[3:], W[:3]]))
    same(sh.select([w, w * 2.0], of(1.0)), W * 2)
    same(sh.select([w, w * 2.0], of(2.0)), W * np.nan)
    with pytest.raises(SemanticError):
        sh.slice_at(w, 4)


def test_reductions(of):
    w = of(W)
    same(w - r.field_reduce_sum(w) / 20.0, W - 17)
    same(r.field_reduce_median(w), 17)
    same(r.max_position(w), [3, 4])
    same(r.winner_take_all(of([1.0, 3, 3])), [0, 1, 0])
    same(r.normalize_l2(w), W / (W**2).sum())


def test_transforms(of):
    c = np.random.default_rng(0).normal(size=(8, 4, 2)) @ [1, 1j]
    f = of(c, kind="complex")
    same(sp.fft(f), np.fft.fft2(c))
    same(sp.fft_inverse(sp.fft(f)), c)
    same(sp.fft_rows(f), np.fft.fft(c, axis=1))
    same(sp.fft_inverse_columns(sp.fft_inverse_rows(f)), np.fft.ifft2(c))
    same(sp.dct_inverse(sp.dct(of(c.real[:4, :4]))), c.real[:4, :4])


def test_transforms_of_any_size(spark, of):
    x = np.random.default_rng(6).normal(size=1 << 12)
    same(sp.fft(of(x)), np.fft.fft(x))
    sp.dct(Field.constant(spark, (1 << 12, 1 << 12), 1.0))
    n, k = 16, np.arange(16)
    b = np.sqrt(2 / n) * np.cos(np.pi * np.outer(k, 2 * k + 1) / (2 * n)) * np.where(k == 0, np.sqrt(0.5), 1)[:, None]
    y = x[: n * n].reshape(n, n)
    same(sp.dct(of(y)), b @ y @ b.T)
    same(sp.dct_inverse_transposed(of(y)), (b.T @ y @ b).T)
    same(sp.dct(of([[3.0]])), [[3]])


def test_transforms_block_by_block(monkeypatch, of):
    monkeypatch.setattr(sp, "BLOCK", 24)
    c = np.random.default_rng(7).normal(size=(4, 2, 8, 3, 2)) @ [1, 1j]
    same(sp.fft(of(c, 1, "complex")), np.fft.fftn(c, axes=(0, 1, 2)))
    same(sp.fft_inverse(of(c[..., 0], kind="complex")), np.fft.ifftn(c[..., 0]))


def test_tensors(of):
    a = np.arange(12.0).reshape(2, 2, 3)
    v = of(a, 1)
    same(t.reduce_sum(v), a.sum(-1))
    same(v * of([[1.0, 2], [3, 4]]), a * np.array([[1.0, 2], [3, 4]])[:, :, None])
    same(t.vector_elements(v, of([2.0, 5, 0], 1)), np.dstack([a[..., 2], np.full((2, 2), np.nan), a[..., 0]]))
    same(t.cross_dot(v, of([1.0, 2, 3])), a @ [1, 2, 3])
    same(t.reverse_cross_dot(v, of([[1.0, 2], [3, 4]])), np.einsum("ijk,ij", a, [[1.0, 2], [3, 4]]))
    x = np.random.default_rng(3).normal(size=(2, 3, 3))
    m = of(x, 2)
    same(t.invert_matrices(m), np.linalg.inv(x))
    same(t.transform(m, m, True, True), x.transpose(0, 2, 1) @ x.transpose(0, 2, 1))
    same(t.transform(m, of([1.0, 2, 3], 1)), x @ [1, 2, 3])
    same(p.luminance(of(a, kind="color")), a @ [0.3811, 0.5783, 0.0402])


def test_ieee(of):
    same(p.log(of([0.0, -1, 1])), [-np.inf, np.nan, 0])
    same(of([1.0, -1, 0]) / of([0.0, 0, 0]), [np.inf, -np.inf, np.nan])
    same(of([5.0, -5]) % 3.0, [2, -2])
    nan = of([np.nan, 1.0])
    same(nan.eq(nan), [0, 1])
    same(p.max_(nan, 0.0), [0, 1])


def test_automaton(of):
    v, bits = np.random.default_rng(5).integers(0, 16, (8, 8, 2)) / 15, 4
    b = np.rint(v.ravel() * 15).astype(int)
    see = lambda o: b[(np.arange(len(b)) + o) % len(b)]
    out = sum((np.array([st.AUTOMATON_RULE >> s & 1 for s in 8 * (see(-7) >> i & 1) + 4 * (b >> i & 1) + 2 * (see(11) >> i & 1) + (see(17) >> i & 1)]) << i) for i in range(bits))
    same(st.random(of(v, 1), bits), (out / 15).reshape(v.shape))


def test_pointwise_chain_is_one_projection(of):
    f = of(W)
    plan = ((f * 2.0 + f) > 3.0).df()._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
