"""Incremental JSON reading against the json module: chunk borders anywhere, broken documents, long values, many files."""

import io
import json

import numpy as np
import pytest

from blockfield.sources import elements, text


def slow(document, arrays):
    data = json.loads(document)
    rows = [(a, i, v) for a, values in data.items() if a in arrays and isinstance(values, list) for i, v in enumerate(values)]
    return rows, {k: v for k, v in data.items() if not (k in arrays and isinstance(v, list))}


def documents():
    rng = np.random.default_rng(4)
    deep = {"é": [1, [2, {"日": "\\\"]}"}]], "n": -1.5e-7, "t": True, "x": None}
    for k in range(12):
        blocks = [[deep, {"i": i, "s": "ü,]}" * int(rng.integers(0, 5))}, [i, [i]], i * 10**int(rng.integers(0, 15)), "a\nb", None][int(rng.integers(0, 6))] for i in range(int(rng.integers(0, 9)))]
        data = {"format": "f", "blocks": blocks, "image": deep, "other": list(range(k)), "more": 12}
        yield json.dumps(data, ensure_ascii=bool(k % 2), indent=[None, 2, "\t"][k % 3])
    yield '{"blocks": "no array", "a": 1}'
    yield "{}"


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 64, 1 << 20])
def test_equals_the_json_module(chunk):
    for document in documents():
        rows = list(elements.events(io.BytesIO(document.encode()), ("blocks", "other"), chunk))
        want, header = slow(document, ("blocks", "other"))
        assert [(a, i, json.loads(v)) for a, i, v, _, _ in rows[:-1]] == want
        assert rows[-1][0] is None and json.loads(rows[-1][2]) == header and rows[-1][4] is None
        assert sum(rows[-1][3].values()) == len(want)


def test_a_broken_document_gives_what_was_read_and_an_error(monkeypatch):
    document = '{"format": "f", "blocks": [{"a": 1}, {"a": 2}, {"a": 3}], "z": 1}'
    for cut in range(len(document)):
        rows = list(elements.events(io.BytesIO(document[:cut].encode()), ("blocks",), 5))
        assert rows[-1][4].startswith("malformed") and [json.loads(v)["a"] for _, _, v, _, _ in rows[:-1]] == [1, 2, 3][: len(rows) - 1]
    for bad in (document + "x", document.replace(":", "=", 1), document.replace("}, {", "} {"), '["a"]', "{1: 2}", "\x00", '{"blocks": [1, nonsense, 3]}'):
        assert list(elements.events(io.BytesIO(bad.encode()), ("blocks",), 4))[-1][4].startswith("malformed")
    assert list(elements.events(io.BytesIO(b'{"a": "\xff"}'), ("blocks",), 4))[-1][4].startswith("malformed")
    monkeypatch.setattr(elements, "LONGEST", 100)
    assert "more than 100" in list(elements.events(io.BytesIO(('{"a": "' + "x" * 5000).encode()), ("blocks",), 64))[-1][4]


def test_memory_is_bounded_by_a_chunk():
    class Endless(io.RawIOBase):
        """A document of a hundred thousand blocks, made as it is read."""

        def __init__(self):
            self.parts = iter(['{"blocks": [', *('{"i": %d},' % i for i in range(100_000)), '{"i": -1}]}'])
            self.rest = b""

        def read(self, n=-1):
            while len(self.rest) < n:
                part = next(self.parts, None)
                if part is None:
                    break
                self.rest += part.encode()
            out, self.rest = self.rest[:n], self.rest[n:]
            return out

    longest, n = 0, 0
    scanner = elements.Scanner
    found = []
    elements.Scanner = lambda handle, chunk: found.append(scanner(handle, chunk)) or found[-1]
    try:
        for row in elements.events(Endless(), ("blocks",), 4096):
            longest, n = max(longest, len(found[0].text)), n + 1
    finally:
        elements.Scanner = scanner
    assert n == 100_002 and longest < 3 * 4096


def test_documents_in_files(spark, tmp_path):
    block = {"block_index": 0, "block_x": 0, "block_y": 0, "tile_x": 0, "tile_y": 0, "num_nonzeros": [1, 0, 0], "quantized": [[0, 5] + [0] * 62, [0] * 64, [0] * 64]}
    image = {"xsize": 8, "ysize": 8, "x_blocks": 1, "y_blocks": 1, "x_tiles": 1, "y_tiles": 1}
    good = {"frame_id": 1, "format": "prepared_tokens.v1", "image": image, "dc_samples": [1, 2, 3], "ac_blocks": [block]}
    files = {"a": good, "b": {**good, "frame_id": 2, "dc_samples": [1, 2]}, "c": {**good, "frame_id": 3, "format": "x"}, "d": {**good, "frame_id": 4, "dc_samples": [1, 2**40, None]}}
    for name, data in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(data, indent=1))
    (tmp_path / "e.json").write_text(json.dumps({**good, "frame_id": 5})[:-30])
    dc, ac, rejects = text.read_prepared_tokens_json(spark, str(tmp_path), "_tokens.v1")
    assert sorted((r.frame_id, r.ordinal, r.value) for r in dc.collect() if r.frame_id == 1) == [(1, 0, 1), (1, 1, 2), (1, 2, 3)]
    assert sorted((r.frame_id, r.channel, r.nonzeros) for r in ac.collect()) == [(f, c, n) for f in (1, 4) for c, n in enumerate([1, 0, 0])]
    found = sorted((r.frame_id, r.rule) for r in rejects.collect() if r.frame_id)
    assert found == [(2, "dc_count"), (3, "format"), (4, "dc_range"), (4, "dc_range"), (5, "malformed")]
