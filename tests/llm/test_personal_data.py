import datetime as dt

import pytest

from tilsim.llm import pii


@pytest.mark.parametrize("sep", "/-")
def test_day_first_dates_are_permuted_one_to_one(sep):
    first = dt.date(1900, 1, 1).toordinal()
    every = [dt.date.fromordinal(n) for n in range(first, dt.date(2100, 1, 1).toordinal())]
    dates = [d.strftime(f"%d{sep}%m{sep}%Y") for d in every if d.day > 12]
    new = [pii.pseudonymize_text(d)[0] for d in dates]
    assert sorted(new) == sorted(dates)
    assert [pii.pseudonymize_text(d, inverse=True)[0] for d in new] == dates
