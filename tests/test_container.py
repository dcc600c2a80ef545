import os

import pytest

from salvora.functions import lha
from salvora.functions.errors import DocumentError, LimitExceeded
from salvora.functions.limits import Budget, Limits
from salvora.sources.compound import CompoundError, CompoundFile, write_compound
from tests.fixtures import BitWriter, lh5, member, wrapped

STREAMS = {"/DocumentText": b"abc" * 30, "/big": os.urandom(70000), "/A/b": b"", "/A/C/d": b"x" * 4096, "/A/C/e": b"y" * 63, "/a b": b"1"}


def test_round_trip_and_order():
    f = CompoundFile(write_compound(STREAMS))
    assert all(f.read(k) == v for k, v in STREAMS.items())
    assert f.streams() == ["/A/C/d", "/A/C/e", "/A/b", "/a b", "/big", "/DocumentText"]
    assert [(e.kind, e.path, e.size, e.children) for e in f.entries()][:3] == [("DIR", "/A", -1, 2), ("DIR", "/A/C", -1, 2), ("DOC", "/A/C/d", 4096, 0)]
    assert f.read("/nothing") is None and f.read("/A") is None


def test_limit_of_a_stream():
    with pytest.raises(CompoundError):
        CompoundFile(write_compound(STREAMS)).read("/big", most=69999)


def test_damage_never_escapes_as_another_error():
    good = bytearray(write_compound(STREAMS))
    for at in range(0, len(good), 997):
        bad = bytearray(good)
        bad[at] ^= 0xFF
        try:
            f = CompoundFile(bytes(bad))
            for p in f.streams():
                f.read(p)
        except (CompoundError, ValueError, IndexError, KeyError, OverflowError):
            pass


def test_single_literal():
    w = BitWriter()
    for v, n in ((1, 16), (0, 5), (0, 5), (0, 9), (0x41, 9), (0, 4), (0, 4)):
        w.put(v, n)
    assert lha.member(member(w.bytes(), 1), Budget()).body == b"A"


@pytest.mark.parametrize("data", [b"x", b"abcabcabcabcabc" * 40, bytes(range(256)) * 9, b"aaaa" * 3000, "銀河鉄道の夜".encode() * 50])
def test_codec_against_an_independent_encoder(data):
    assert lha.decode(lh5(data, 700), len(data)) == data


def test_wrapper_and_budget():
    assert lha.unwrap(wrapped(b"hello hello hello"), Budget()) == b"hello hello hello"
    budget = Budget(Limits(total_bytes=1))
    one = member(lh5(b"A"), 1)
    assert lha.member(one, budget).body == b"A"
    with pytest.raises(LimitExceeded) as e:
        lha.member(one, budget)
    assert (e.value.resource, e.value.limit, e.value.actual) == ("total LH5 decompressed bytes", 1, 2)
    assert budget.spent == 1
    with pytest.raises(DocumentError, match="ended early"):
        lha.decode(lh5(b"hello")[:3], 5)
