"""Objects in JSON payloads against a walk over the parsed payload."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewindow.sources.objects import objects_with

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-5, 5) | st.floats(allow_nan=False) | st.text(alphabet='a"\\{[,:é \n', max_size=4),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["status", "variations", "x", "é"]), x, max_size=4),
    max_leaves=25,
)


def walked(value, keys):
    if isinstance(value, list):
        return [y for x in value for y in walked(x, keys)]
    if not isinstance(value, dict):
        return []
    at = value
    for k in keys:
        at = at.get(k) if isinstance(at, dict) else None
    return ([value] if at is not None else []) + [y for x in value.values() for y in walked(x, keys)]


@settings(max_examples=400, deadline=None)
@given(VALUES, st.sampled_from(["status", "status.variations", "status.status"]), st.booleans(), st.sampled_from([None, 2]))
def test_as_a_walk(value, path, ascii_only, indent):
    text = json.dumps(value, ensure_ascii=ascii_only, indent=indent)
    assert [json.loads(x) for x in objects_with(f" {text}\n", path)] == walked(value, path.split("."))


def test_what_is_no_json_gives_none():
    good = '{"a":{"b":1},"c":["x",2.5e3,true,null,""]}'
    assert objects_with(good, "a.b") == [good]
    for k in range(len(good)):
        assert objects_with(good[:k], "a.b") == []
        if good[k] in '{}[],:"':
            assert objects_with(good[:k] + good[k + 1 :], "a.b") == []
    for bad in (None, "", " ", "{} {}", '{"a" 1}', '{"a":1,}', "[1,]", "[1 2]", '{1:2}', '{"a":{"b":1}}x', '{"a":01}', "{'a':1}", '{"a":{"b":1}]', '"\\x"'):
        assert objects_with(bad, "a") == [] and objects_with(bad, "a.b") == []
    assert objects_with('{"a":1,"a":null}', "a") == [] and objects_with('{"\\u0061":1}', "a") == ['{"\\u0061":1}']


def test_depth():
    inner, deep = '{"a":{"b":1}}', 100_000
    assert objects_with("[" * deep + inner + "]" * deep, "a.b") == [inner]
    assert objects_with('{"x":' * deep + inner + "}" * deep, "a.b") == [inner]
    assert objects_with("[" * deep, "a.b") == []
