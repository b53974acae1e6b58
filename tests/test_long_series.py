import numpy as np

from driftglass.operators import longfit


def test_strips_sum_as_one_return_after_another():
    g = np.random.default_rng(2)
    points = np.array([(0.05, 0.1, 0.8), (0.2, 0.0, 0.7), (0.3, 0.4, 0.0), (1e-4, 0.05, 0.9489)])
    for n in (1, 15, 17, 4099, 20_000):
        q = g.normal(size=n) ** 2
        before = g.uniform(0.5, 2, (4, len(points)))
        f, gradient, info = longfit.summed(q, points, before)
        own = longfit.mapped(q, points)
        for j, (omega, alpha, beta) in enumerate(points):
            s, d = before[0, j], before[1:, j].copy()
            want = [0.0, np.zeros(3), np.zeros((3, 3))]
            zero = np.zeros(4)
            for x in q:
                want[0] += np.log(s) + x / s
                want[1] = want[1] + d / s * (1 - x / s)
                want[2] = want[2] + np.outer(d, d) / s**2
                s, d = omega + alpha * x + beta * s, np.array([1, x, s]) + beta * d
                zero = np.array([omega + alpha * x + beta * zero[0], 1 + beta * zero[1], x + beta * zero[2], zero[0] + beta * zero[3]])
            np.testing.assert_allclose(f[j], want[0], rtol=1e-10)
            np.testing.assert_allclose(gradient[:, j], want[1], rtol=1e-8, atol=1e-8)
            np.testing.assert_allclose(info[:, j], want[2][np.triu_indices(3)], rtol=1e-9)
            np.testing.assert_allclose(own[:, j], zero, rtol=1e-10)


def test_the_whole_step_is_tried_alone_and_starts_that_meet_go_on_as_one():
    asked = []

    def evaluate(points):
        asked.append(sum(map(len, points.values())))
        return {(k, j): (float(((p - 1) ** 2).sum()), 2 * (p - 1), 2 * np.eye(2)) for k, ps in points.items() for j, p in enumerate(ps)}

    got = longfit.descend(evaluate, {"x": [np.array([3.0, 1.0]), np.array([-2.0, 5.0])]}, {"x": lambda p: p})
    assert len(got["x"]) == 1 and abs(got["x"][0][0] - 1).max() < 1e-9 and asked == [2, 2]  # 12 at once before
