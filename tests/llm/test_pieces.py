import numpy as np
import pytest
import sentencepiece

from lectern.llm import pieces

TEXTS = [None, "", " ", "  two  spaces ", "the of and\n\n\tnew\x00line", "▁ mark ▁▁", "héé ñandú 日本語 \U0001f600\U0001f600", "x" * 3000, "é ﬁ ​", "Licensed under CC BY-NC 4.0.", " lead", "trail "]


@pytest.fixture(scope="module")
def own():
    return pieces.Codec(pieces.default_path())


def brute(own, unit):
    """The best score, over every cut of the unit, by the vocabulary as the library gives it."""
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    score = {model.id_to_piece(i).replace("▁", " "): model.get_score(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    best = [0.0]
    for end in range(1, len(unit) + 1):
        options = [best[s] + score[unit[s:end]] for s in range(end) if unit[s:end] in score]
        if unit[end - 1] not in score:
            options.append(best[end - 1] + own.cost)
        best.append(max(options))
    return best[-1], score


def test_best_segmentation(own):
    rng = np.random.default_rng(1)
    for text in [*filter(None, TEXTS[3:]), *("".join(rng.choice(list("aeinrst hö▁λ\n"), 40)) for _ in range(60))]:
        if len(text) > 200:
            continue
        for unit in text.split("▁"):
            unit = " " + unit
            want, score = brute(own, unit)
            ids = [i for u in own.units(unit) for i in own.best(u)]
            total, held = 0.0, b""
            for i in ids:
                if i in own.bytes:
                    held += own.spelled[i]
                    try:
                        held.decode()
                    except UnicodeDecodeError:
                        continue
                    total, held = total + own.cost, b""
                else:
                    total += score[own.spelled[i].decode()]
            assert abs(total - want) < 1e-6 * abs(want) + 1e-6


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t, "n") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "n"), (None, "null id", None)], "doc_id bigint, text string, ids string")
    got = pieces.encode(df).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.round_trip for r in got)
    assert {r.doc_id: r.n_pieces for r in got}[0] == 0
    decoded = pieces.decode(pieces.encode(df)).collect()
    want = dict(enumerate(TEXTS)) | {None: "null id"}
    assert all(r.decoded_text == (want[r.doc_id] or "") for r in decoded)
    assert pieces.with_ids(df).columns == ["doc_id", "text", "ids", "piece_ids"]
    assert pieces.encode(df.limit(0)).count() == 0


def test_a_small_table_changes_nothing(own):
    small = pieces.Codec(pieces.default_path(), table=3)
    for t in filter(None, TEXTS):
        assert small.encode(t).tolist() == own.encode(t).tolist()
