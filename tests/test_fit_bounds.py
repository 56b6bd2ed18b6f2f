"""A trim that can't be better by a few of its values isn't evaluated at all of them; the fit is the same."""

import numpy as np

from codepend.operators import significance as sig


def test_bad_trims_are_judged_by_few_values(monkeypatch):
    rng = np.random.default_rng(0)
    v = np.sort(np.concatenate([rng.beta(2, 20, 3000) * 0.5, rng.uniform(0.3, 0.9, 600)]))
    sizes, real = [], sig.beta_cdf
    monkeypatch.setattr(sig, "beta_cdf", lambda x, *rest: sizes.append(np.size(x)) or real(x, *rest))
    got = sig.fit_many([v])[0]
    assert got[4] < 0.01 and sum(n > 3000 for n in sizes) < len(sig.TRIMS)
    whole = sum(sizes)
    monkeypatch.setattr(sig, "SEEN", 1, raising=False)
    sizes.clear()
    assert np.allclose(sig.fit_many([v])[0], got, rtol=1e-12) and whole < sum(sizes)
