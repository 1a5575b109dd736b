import math

import numpy as np

from trackloom.operators import shape as s


def ring(n=37, r=20.0, part=1.0):
    t = np.linspace(0, math.pi * part, n)
    return np.column_stack([r * np.cos(t), r * np.sin(t), t])


def test_circle():
    o, r = s.circle(np.array([1.0, 0]), np.array([0, 1.0]), np.array([-1.0, 0]))
    assert np.allclose(o, 0) and abs(r - 1) < 1e-12
    assert s.circle(np.array([0.0, 0]), np.array([1.0, 0]), np.array([2.0, 0])) is None


def test_arc_lies_on_the_circle_and_keeps_ends():
    p = ring(12)
    out = s.with_arcs(p)
    assert np.allclose(out[[0, -1]], p[[0, -1]]) and np.abs(np.hypot(*out[:, :2].T) - 20).max() < 0.05 and len(out) > len(p)
    line = np.column_stack([np.arange(20.0), np.zeros(20), np.zeros(20)])
    assert (s.with_arcs(line) == line).all() and s.bends(line) == []
    assert s.arc(np.array([[0, 0, 0], [5, 9, 0], [6, 1, 0], [10, 0, 0.0]])) is None


def test_loop_at_u_turn():
    p = np.array([[0, 0, 0], [50, 0, 1], [0, 0.1, 2.0]])
    out = s.with_loops(p)
    assert len(out) > 20 and np.hypot(out[:, 0] - 50, out[:, 1] + 6)[2:-1].max() < 6.01
    straight = np.array([[0, 0, 0], [50, 0, 1], [99, 0, 2.0]])
    assert (s.with_loops(straight) == straight).all()


def test_bends_are_eased():
    p = np.array([[0, 0, 0], [10, 0, 0], [10, 1, 0], [0, 1, 0], [-10, 1, 0.0]])
    before, out = np.abs(s.turns(p)).max(), s.eased(s.spaced(p, 0.5), 2.0, 400)
    assert np.abs(s.turns(out)).max() < before and np.allclose(out[[0, -1]], p[[0, -1]])


def test_splines_go_through_all_points():
    p = np.array([[0, 0, 0], [10, 0, 0], [20, 5, 1], [30, 5, 1], [40, 0, 0.0]])
    out = s.splined(p)
    assert len(out) > len(p) and all((np.abs(out - q).sum(1) < 1e-9).any() for q in p)
    assert (s.splined(p[:3]) == p[:3]).all()


def test_shift_straighten_prune_space():
    line = np.column_stack([np.zeros(30), np.arange(30.0) * 10, np.zeros(30)])
    assert np.allclose(s.shifted(line, 2)[:, 0], 2) and np.allclose(s.shifted(line, -2)[:, 0], -2)
    bent = line + np.where(np.arange(30) % 2, 0.1, 0)[:, None] * [1, 0, 0]
    assert np.abs(s.straightened(bent)[1:-1, 0]).max() < 0.1
    assert len(s.pruned(line)) == 2 and len(s.pruned(ring(30))) > 4
    assert np.allclose(s.lengths(s.spaced(line, 3.0)), 10 / 3)


def test_long_loops():
    assert s.long_loops(ring(60, 8.0, 2.0)) and not s.long_loops(ring(60, 8.0, 1.0)) and s.long_loops(ring(3)) == []


def test_bends_are_eased_until_none_is_left():
    p = s.spaced(np.array([[0, 0, 0], [60, 0, 0], [60, 4, 0], [0, 4, 0.0]]), 1.0)
    out = s.eased(p)
    d = s.lengths(out)
    assert ((d[:-1] + d[1:]) / 2 >= 6.0 * (1 - 1e-6) * np.abs(s.turns(out))).all() and np.allclose(out[[0, -1]], p[[0, -1]])
