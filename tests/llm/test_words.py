"""Words of language identification: long runs of letters are read whole."""

import numpy as np

from moraine.llm import langid


def test_long_runs_are_read_whole():
    for run in ("a" * 25, "donaudampfschifffahrtsgesellschaftskapitän", "你好" * 100, "x" * 24):
        got = langid.words_of(run)
        assert "".join(got) == run and max(map(len, got)) <= langid.PIECE
    assert langid.words_of("日本語English中文 Été naïve ПриветWorld µm") == ["日本語", "english", "中文", "été", "naïve", "привет", "world", "µm"]
    word = "abcdefghijklmnopqrstuvwx"
    assert len(langid.word_features(word, {word})) == langid.SLOTS and len(langid.word_features(word[:-1] + "z", ())) == langid.SLOTS - 1


def test_a_switch_inside_a_run_without_spaces():
    a, b = "今天天气很好我们去公园", "สวสดครบผมชอบกนขาว"
    crf = langid.fit([("zh", (a + " ") * 60), ("th", (b + " ") * 60), ("en", "the day is nice we go to a park " * 60)])
    tagger = langid.Tagger(crf)
    filler = a * 3
    (lang, _, n, labels) = tagger.tag([filler + b * 20 + filler])[0]
    assert lang == "th" and n > 10 and {crf.labels[i] for i in np.unique(labels)} >= {"th", "zh"}


def test_only_letters_are_words():
    assert langid.words_of("² ½ Ⅷ ①") == [] and langid.words_of("m² x½y 3rd") == ["m", "x", "y", "rd"]
    assert langid.words_of("e\u0301te\u0301 हिन्दी ²日²本") == ["e\u0301te\u0301", "हिन्दी", "日", "本"]
    crf = langid.fit([("en", "the day is nice " * 30), ("fr", "le jour est beau " * 30)])
    assert [t[:3] for t in langid.Tagger(crf).tag(["² ½", "", None])] == [("und", 0.0, 0)] * 3
