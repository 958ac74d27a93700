import hashlib
import zlib

from fixtures import KINDS, rows, table

from pitchframe.llm.media_columns import from_png, media_store, op9_media_columns, padded, parsed, read_back, resolved, sequences, to_png
from hypothesis import given, settings
from hypothesis import strategies as st


def test_payloads_survive_their_stored_form():
    for raw in (b"", b"a", bytes(range(256)) * 9, b"x" * 64, b"y" * 65):
        payload = padded(raw)
        assert len(payload) % 64 == 0 and len(payload) > 0 and payload.startswith(raw)
        assert from_png(to_png(payload)).tobytes() == payload


def test_values_equal_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op9_media_columns(spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        payload = padded(texts[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(texts[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(to_png(payload)).hexdigest() and r["media_bytes"] == len(to_png(payload))


def test_all_cases_have_their_row(spark):
    df = table(spark)
    store = read_back(media_store(df.select("text")))
    assert {r["n_bytes"] for r in store.collect()} == {len((t or "").encode()) for _, t, *_ in rows()}
    assert media_store(spark.createDataFrame([], KINDS).select("text")).count() == 0


def test_sequences_keep_order_positions_and_captions(spark):
    html = '<p>before</p><figure><img src="sha256:aa" alt="x"><figcaption>a <b>cap</b></figcaption></figure><p>after</p><img src="other.png"><video src="sha256:bb"></video>'
    assert [(x["position"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in parsed(html)] == [
        (0, "text", "before", None), (1, "media", "aa", "a cap"), (2, "text", "after", None), (3, "media", None, None), (4, "media", "bb", None)
    ]
    pages = spark.createDataFrame([(1, html, "extra"), (2, None, "e"), (3, "plain", "e"), (1, html, "extra")], "doc_id long, html string, digest string")
    made = sequences(pages)
    assert sorted(len(r["sequence"]) for r in made.collect()) == [0, 1, 5, 5]
    store = spark.createDataFrame([("aa", 5)], "digest string, n_bytes long")
    got = resolved(made, store).filter("kind = 'media'").collect()
    assert sorted((r["position"], r["n_bytes"] or 0) for r in got) == [(1, 5), (1, 5), (3, 0), (3, 0), (4, 0), (4, 0)]
    assert {r["url"] for r in got} == {"sha256:aa", "other.png", "sha256:bb"}


def test_pages_of_other_forms():
    open_head = "<html><head><title>t</title><meta charset=x><body><p>shown</p><script>no</script><img src=a.png alt=one><p>more</p><img src='sha256:cc'>"
    assert [(x["kind"], x["text"] or x["url"]) for x in parsed(open_head)] == [("text", "shown"), ("media", "a.png"), ("text", "more"), ("media", "sha256:cc")]
    assert parsed("<figcaption>alone</figcaption>")[0]["text"] == "alone" and parsed("") == parsed(None) == []


def test_features_are_those_of_the_samples(spark):
    raw = b"ab" * 40
    flat = list(padded(raw))
    n = len(flat)
    mean = sum(flat) / n
    spread = (sum(x * x for x in flat) / n - mean * mean) ** 0.5
    step = sum(abs(a - b) for a, b in zip(flat, flat[1:])) / (n - 1)
    want = f"{n // 64}x64;{mean:.4f};{spread:.4f};{flat.count(0) / n:.4f};{step:.4f}"
    store = media_store(spark.createDataFrame([(raw.decode(),), (raw.decode(),)], "text string"))
    assert [r["feature"] for r in read_back(store).collect()] == [want]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["<![", "[x", "]]>", "<!", "<!--", "-->", "<?", "</", "<img src=a>", "<figcaption>", "<script>", "&#x;", "&amp", ">", "<", "\"", "'", "=", "foo[ x ", "CDATA[", "p>", " ", "\x00", "é"]), max_size=25).map("".join))
def test_no_page_stops_the_parser(html):
    items = parsed(html)
    assert [x["position"] for x in items] == list(range(len(items))) and {x["kind"] for x in items} <= {"text", "media"}


def test_marked_sections_are_comments():
    found = parsed("<p>a<![foo[ x ]]>b</p><![CDATA[ <img src=u> ]]>c<![if IE]>d<![endif]>")
    assert "".join(x["text"] or "" for x in found).replace(" ", "") in ("ab]]>cd", "abc]]>d", "abcd", "ab]]>]]>cd", "ab]]>cd")
    assert parsed("<![") == [] or parsed("<![")[0]["kind"] == "text"
