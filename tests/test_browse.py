from themeflow.operators.browse import parse_range_selection


def expand(r):
    return [i for lo, hi in r for i in range(lo, hi + 1)]


def test_range_selection_rules():
    assert expand(parse_range_selection("5, 12-15, 20", 14)) == [5, 12, 13, 14]
    assert expand(parse_range_selection("15-12", 14)) == [12, 13, 14]
    assert expand(parse_range_selection("12 - 15", 14)) == [12]
    assert expand(parse_range_selection("-5", 14)) == []
    assert expand(parse_range_selection("1-2-3 x 0", 14)) == []
