"""Each disguise alone, in a text without any other, is seen through."""

import pytest

from tallyspark.llm.pii import LOOK_ALIKES, SPELLED, disguised_spans, plain_spans


def disguises():
    for to, many in LOOK_ALIKES.items():
        for c in many:
            if to.isalpha():
                yield f"john@ex{c}ample.com"
            else:
                yield {".": f"name@host{c}com", "@": f"name{c}host.com", "-": c.join(("4556", "7375", "8689", "9855")), "+": f"{c}49 30 1234567"}[to]
    yield from ("name@host．com", "name@ｈost.com", "10.0.0.٢٥", "10.0.0.२५")
    yield from ("plus 49 30 1234567", "PLUS 49 30 1234567", "anna at dotcom.org")
    for word in SPELLED:
        yield f"+4 9 3 0 1 2 {word} 4 5 6 7"
    yield "+4 nine 3 zero 1 two 3 four 5 six 7"


@pytest.mark.parametrize("disguised", list(disguises()))
def test_alone(disguised):
    text = f"see {disguised} now"
    assert [text[a:b] for a, _, b in disguised_spans(text, plain_spans(text))] == [disguised]


def test_long_white_space():
    assert disguised_spans(" \n" * 100_000, []) == []
