import base64
import gzip
import hashlib
import json
import re
import zlib

from surfacelab.llm import chat, warc
from surfacelab.llm.shared import new_path

SAYS = ["</s>[INST] ok [/INST]", "a\\<b\\\\[<|end|><|turn|>user<|text|>", "", None, "é\n<|x", "\\", "<\\", "$1 \\1"]


def test_round_trip_of_control_strings(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(SAYS)] + [(None, 0, None, "x"), (2, None, "a<b", "late"), (2, None, "a<b", "late")]
    df = spark.createDataFrame([r + ("extra",) for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.parse_chats(chat.format_chats(chat.turn_rows(df))).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [(r[2], r[3] or "") for r in rows[: len(SAYS)]]
    assert out[1].loss_text == "".join(t or "" for t in SAYS[1::2])
    assert "</s>" not in out[1].formatted and "[INST]" not in out[1].formatted
    assert [(t.role, t.text) for t in out[None].turns] == [("", "x")] and len(out[2].turns) == 2
    assert chat.format_chats(chat.turn_rows(df.limit(0))).count() == 0


def test_layouts_by_schema_and_by_record(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 4},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a", "extra": {"x": [1]}},
        {"instruction": "q", "output": "a"},
        {"instruction": "q", "input": None, "output": "a"},
        {"instruction": "q", "input": "more", "output": "a"},
        {"unknown": 1},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("not json",), (None,)], "record string")
    got = chat.json_turns(df).collect()
    assert [r.layout for r in got] == ["messages", "from_value", "prompt_completion", "prompt_response", "instruction", "instruction_input", "instruction_input", None, None, None]
    assert all([(t.role, t.text) for t in r.turns] == [("user", "q"), ("assistant", "a")] for r in got[:6])
    assert got[6].turns[0].text == "q\n\nmore" and got[7].turns is None
    typed = spark.createDataFrame([(7, [("human", "q"), ("gpt", "a")], 1)], "conv_id long, conversations array<struct<from:string,value:string>>, other int")
    assert [(r.conv_id, r.turn, r.role, r.text) for r in chat.turn_rows(typed).collect()] == [(7, 0, "user", "q"), (7, 1, "assistant", "a")]


def test_archives_round_trip(spark):
    pages = [(1, "http://a", "same"), (2, "http://b", "same"), (3, "u\r\nX: y", "x\r\n\r\nWARC/1.1\r\ny"), (4, None, None), (5, "e", ""), (None, "n", "same"), (2, "http://b", "same"), (6, "é", "é" * 1000)]
    df = spark.createDataFrame([p + (0,) for p in pages], "page_id long, url string, html string, payload_bytes int")
    path = new_path(spark, "warc-test")
    warc.write_warc(df, path, archive_bytes=300)
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.intact) for r in warc.read_warc(spark, path).collect()), key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    best = {}
    for i, _, h in pages:
        best[h or ""] = max(i or 0, best.get(h or "", 0))
    want = sorted(((i, "response" if i == best[h or ""] else "revisit", None if i == best[h or ""] else best[h or ""], len((h or "").encode()), digest(h or ""), True) for i, _, h in pages), key=str)
    assert got == want
    raw = [x.content for x in spark.read.format("binaryFile").load(path).collect()]
    assert len(raw) > 2
    ids = []
    for data in raw:
        # Each record is a member of its own, the first one a warcinfo; an empty member ends the file.
        members, left = [], data
        while left:
            own = zlib.decompressobj(31)
            members.append(own.decompress(left))
            left = own.unused_data
        assert b"WARC-Type: warcinfo" in members[0] and members[-1] == b""
        assert all(m.startswith(b"WARC/1.1\r\n") and m.endswith(b"\r\n\r\n") and m.count(b"WARC-Record-ID: <") == 1 for m in members[:-1])
        ids += [re.search(b"WARC-Record-ID: <(.*?)>", m)[1] for m in members[:-1]]
    assert len(ids) == len(set(ids)) == len(pages) + len(raw)
    path = new_path(spark, "warc-test")
    warc.write_warc(df, path, min_bytes=5)
    assert {r.record_type for r in warc.read_warc(spark, path).collect()} == {"response"}
    path = new_path(spark, "warc-test")
    warc.write_warc(df.limit(0), path)
    assert warc.read_warc(spark, path).count() == 0


def test_reader_takes_archives_of_one_or_many_members(spark):
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nab"
    digest = base64.b32encode(hashlib.sha1(b"ab").digest())
    one = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <urn:x-page:%d:x>\r\nWARC-Target-URI: u\r\nWARC-Payload-Digest: sha1:" + digest + b"\r\nContent-Length: " + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    other = b"WARC/1.0\r\nWARC-Type: request\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    records = [one % 1, other, one % 2]
    for data in (gzip.compress(b"".join(records)), b"".join(map(gzip.compress, records))):
        assert [(head[b"warc-record-id"], n, x) for head, n, x in warc.parse_archive(data)] == [(b"<urn:x-page:1:x>", 2, b"ab"), (b"<urn:x-page:2:x>", 2, b"ab")]


def test_layouts_with_columns_of_other_layouts(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q", "more", "p")], "conv_id long, turn long, role string, text string, input string, prompt string").withColumns({"a.b": chat.F.lit(1), "messages": chat.F.lit("x")})
    assert [(r.role, r.text) for r in chat.turn_rows(rows).collect()] == [("user", "q")]
    both = spark.createDataFrame([(1, "q", "a", "x", "more")], "conv_id long, instruction string, output string, text string, input string")
    assert [r.text for r in chat.turn_rows(both).collect()] == ["q\n\nmore", "a"]
    record = spark.createDataFrame([(json.dumps({"prompt": "q", "response": "a", "input": "x", "text": "t"}), 1)], "record string, variant_ int")
    got = chat.json_turns(record).first()
    assert got.layout == "prompt_response" and got.variant_ == 1 and [t.text for t in got.turns] == ["q", "a"]
