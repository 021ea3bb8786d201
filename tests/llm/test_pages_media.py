"""Faults once found in pages, media and token blocks, each as a small case."""

import numpy as np
import pytest

from quillmesh.llm import gif, pages, tokenfile

FINNISH = (
    "Talvi saapui tänä vuonna aikaisin ja peitti pellot lumella ennen kuin kukaan ehti korjata viimeisiä perunoita maasta. Kylän vanhimmat muistelivat, "
    "ettei sellaista ollut nähty vuosikymmeniin, jolloin hevoset vajosivat kinoksiin ja posti kulki suksilla. Lapset kuitenkin iloitsivat, sillä koulu suljettiin kahdeksi viikoksi."
)
CHINESE = "春天来了，村子里的人们开始在田里劳作。老人说今年的雨水比往年多，所以庄稼会长得很好。" * 6
STORY = "and the long story of the house by the sea goes on for a while, as it was told to all of them. " * 3


@pytest.mark.parametrize("text", [FINNISH, CHINESE])
def test_unlisted_languages_stay(text):
    page = f"<body><div class='menu'><a href=a>Etusivu</a> <a href=b>Uutiset</a></div><div><p>{text}<p>{text}</div><div><a href=c>{text[:60]}</a><a href=d>{text[60:120]}</a></div></body>"
    assert pages.main_text(page) == f"{text} {text}"
    assert pages.main_text(f"<article><p>{text}</p></article>") == text
    # a list of names is no prose, whatever its language
    assert pages.main_text("<div>" + "Kuopio Lahti Oulu Turku Vaasa " * 10 + f"</div><div>{STORY}</div>") == STORY.strip()


def test_implied_ends():
    hidden = {"li": "<ul><li class=share>Share this<li>%s</ul>", "dd": "<dl><dt class=share>Share<dd>%s</dl>", "td": "<table><tr><td class=sidebar>Site map<td>%s</table>"}
    hidden |= {"tr": "<table><tr class=nav><td>Site map<tr><td>%s</table>", "p": "<p class=share>Share this<div>%s</div>", "body": "<table><thead class=menu><tr><td>Site map<tbody><tr><td>%s</table>"}
    for page in hidden.values():
        assert pages.main_text(page % STORY) == STORY.strip(), page
    # an inner list's item does not end the outer one, nor does a table in a cell
    inner = f"<ul><li class=share>Share<ul><li>{STORY}</ul></ul><p>{STORY}</p>"
    assert pages.main_text(inner) == STORY.strip()
    assert pages.main_text(f"<table><tr><td class=sidebar>Map<table><tr><td>{STORY}</table></table><div>{STORY}</div>") == STORY.strip()


def test_references_end_with_their_run():
    assert pages.main_text(f"<article><p>AT&<b>lt;</b> &lt;T&amp;T&gt; {STORY}</p></article>") == f"AT&lt; <T&T> {STORY}".strip()


def test_whole_page_without_article():
    page = f"""<html><head><title>T</title></head><body><div id=top-nav><ul><li><a href=a>Home</a><li><a href=b>News</a></ul></div>
    <h1>The &eacute;nd of it</h1><div class=content><p>{STORY}<p>It was so.<p>{FINNISH}</div>
    <div class=comments><p>{STORY}</div><form>Your <label>name</label></form><footer>&copy; all of us</footer></body></html>"""
    assert pages.main_text(page) == " ".join(f"The énd of it {STORY} It was so. {FINNISH}".split())


@pytest.mark.parametrize("part", ["<li>", "<dd>", "<td>", "<tr><td>", "<li><div>", "<li></li>", "<option>", "<p><span class=a>", "<table>"])
def test_many_open_elements_take_linear_time(part):
    import time

    start = time.process_time()
    pages.main_text("<li><ul>" + "<div>" * 20_000 + part * 20_000)
    assert time.process_time() - start < 5


#: A picture of 10 x 10 pixels in four colours, made by hand: codes of three bits and more, one clear code.
SAMPLE = bytes.fromhex(
    "474946383961 0A000A00 910000 FFFFFF FF0000 0000FF 000000 21F9040000000000 2C000000000A000A0000 02 16 8C2D99872A1CDC33A00275EC95FAA8DE608C04914C01 00 3B".replace(" ", "")
)


def test_decoder_reads_a_known_file():
    (frame,) = gif.gif_decode(SAMPLE)
    rows = ["1111122222"] * 3 + ["1110000222"] * 2 + ["2220000111"] * 2 + ["2222211111"] * 3
    assert ["".join(map(str, r)) for r in frame.indices.tolist()] == rows
    assert frame.rgb[0, 0].tolist() == [255, 0, 0] and frame.rgb[0, 9].tolist() == [0, 0, 255] and frame.rgb[4, 4].tolist() == [255, 255, 255]


def test_cut_and_crafted_files_raise():
    whole = gif.gif_encode(bytes(range(256)) * 4)
    for cut in range(len(whole)):
        with pytest.raises(ValueError):
            gif.gif_decode(whole[:cut])
    wide = bytearray(gif.gif_encode(bytes(64)))
    wide[6:10] = b"\xff" * 4
    with pytest.raises(ValueError, match="canvas"):
        gif.gif_decode(bytes(wide))
    tall = bytearray(SAMPLE)
    at = tall.index(b"\x2c", 30)
    tall[at + 5 : at + 9] = b"\xff" * 4
    with pytest.raises(ValueError, match="too large"):
        gif.gif_decode(bytes(tall))


def test_a_stream_is_not_decoded_beyond_its_samples():
    long = gif.lzw_encode(bytes(3_000_000))
    assert gif.lzw_decode(long, 8, 64) == bytes(64) and gif.lzw_decode(long, 8, 3_000_000) == bytes(3_000_000)
    mixed = bytes(np.random.default_rng(1).integers(0, 9, 5000, dtype=np.uint8))
    for n in (1, 2, 63, 64, 4999, 5000):
        assert gif.lzw_decode(gif.lzw_encode(mixed), 8, n) == mixed[:n]


def test_an_id_before_very_many_others():
    many = np.arange(10, 40_010).repeat(3)
    ids = np.empty(2 * len(many) + 40_000, np.int64)
    ids[: 2 * len(many) : 2], ids[1 : 2 * len(many) : 2] = 1, many
    ids[2 * len(many) :: 2], ids[2 * len(many) + 1 :: 2] = 1, np.tile([2, 3], 10_000)
    parts = tokenfile.Prior.parts(ids)
    assert parts[2].max() == tokenfile.MOST_AFTER
    prior = tokenfile.Prior.unpack(tokenfile.Prior.pack(*parts))
    steps = np.diff(prior.one.reshape(-1, len(prior.vocab) + 1).astype(np.int64), axis=1)
    assert steps.min() >= 0 and (np.diff(prior.zero) > 0).all()
    assert {2, 3} <= set(prior.vocab[np.flatnonzero(steps[prior.row[1 == prior.vocab][0] // (len(prior.vocab) + 1)])].tolist())
    packed, blocks = tokenfile.encode_blocks(ids)
    assert np.array_equal(tokenfile.decode_blocks(packed, blocks), ids)
