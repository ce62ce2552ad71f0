import pytest

from voxloom.llm import pairs
from voxloom.llm.pairs import judge

PASSAGE = "In 1769, Dora Lifted the foreign crown in the mountain hut, because Kel sold the radio along the canal. She named it None of the Above."


@pytest.mark.parametrize(
    ("question", "answer", "context", "want"),
    [
        ("Where is it?", None, None, ["empty"]),
        ("Where is it?", "<text> ​", None, ["empty"]),
        ("Where is it?", "(empty)", "the empty hut", ["empty"]),
        ("Where is it?", "N/A", None, ["empty"]),
        ("What did she name it?", "None of the Above", PASSAGE, []),
        ("Where was it?", "in the mountain hut", PASSAGE, []),
        ("Where was it?", "in the mount", PASSAGE, ["truncated"]),
        ("Where was it?", "in the", PASSAGE, ["truncated"]),
        ("Who sold the radio?", "Dora L", PASSAGE, ["truncated"]),
        ("Who explained the used stone?", "Who explained the ued stone?", PASSAGE, ["copied_question"]),
        ("When was it?", "1769", PASSAGE, []),
        ("Where was it that Kel sold the radio?", "im Kloster", PASSAGE, ["wrong_language"]),
        ("How can I do it?", "I'm sorry, but I can't help with that.", None, ["refusal"]),
        ("Wie kann ich das tun?", "Diese Frage kann ich leider nicht beantworten.", None, ["refusal"]),
        ("Wie kann ich das tun?", "I can't help you with that, I am not able to.", None, ["wrong_language", "refusal"]),
        ("Where is the key to the old hut?", "Je ne peux pas répondre à cette question.", None, ["wrong_language", "refusal"]),
        ("Where is the key to the old hut?", "Mi dispiace, non posso aiutarti con questo.", None, ["wrong_language", "refusal"]),
        ("Where is the key to the old hut?", "Sorry, ik kan je daar niet mee helpen.", None, ["wrong_language", "refusal"]),
        ("Hoe kan ik het doen met een touw?", "Sorry, ik kan je daar niet mee helpen.", None, ["refusal"]),
        ("Onde está a chave da casa?", "Desculpe, não posso ajudar com isso.", None, ["refusal"]),
        ("¿Dónde está la llave de la casa?", "Lo siento, no voy a ayudarte con eso.", None, ["refusal"]),
        ("How do you get by?", "I am unable to reach the store, so I cook rice with what is left.", None, []),
        ("How do you get by?", "I can't find the key, so I use the back door.", None, []),
        ("How do you get by?", "I can't.", None, ["refusal"]),
        ("How can I do it?", "I'm sorry, but I cannot help with the (", None, ["refusal", "truncated"]),
        ("What is the capital of the old empire?", "What is the capital of", None, ["copied_question", "truncated"]),
        ("How can I do it?", "I can't recommend this enough: try it.", None, []),
        ("How can I do it?", "I'm sorry for the confusion earlier. Try it.", None, []),
        ("What is the best way to test it?", "You asked: What is the best way to tset it?", None, ["copied_question"]),
        ("What is the best way to test it?", "What is the best way to test it? Use a rope.", None, []),
        ("Repeat the following sentence exactly: Dora lifted the crown.", "Dora lifted the crown.", None, []),
        ("Translate into German: Dora lifted the crown.", "Dora hob die Krone und sie ist nicht da.", None, []),
        ("How can I do it?", "Use a rope. Then the (", None, ["truncated"]),
        ("How can I do it?", "Use a rope:\n```\nrun()", None, ["truncated"]),
        ("How can I do it?", "1. Use a rope.\n2.", None, ["truncated"]),
        ("How can I do it?", "Use a rope on the bridge. Hope this helps", None, []),
        ("Is it safe? Answer in one word.", "yes", None, []),
        ("Как дела у вас?", "Хорошо, спасибо.", None, []),
        ("How are you today?", "Хорошо, спасибо.", None, ["wrong_language"]),
        (None, "Use a rope.", None, []),
        (" ", "Das ist nicht die Frage.", None, []),
    ],
)
def test_rules(question, answer, context, want):
    assert judge(question, answer, context)[0] == want


def test_pairs_of_a_chat(spark):
    m = lambda *x: [{"role": r, "content": c} for r, c in x]
    df = spark.createDataFrame(
        [("a", m((" User", "q1"), ("system", "s"), ("GPT", "r1"), ("bot", "r2"), ("human", "q2"), ("tool", "t"))), ("a", m(("user", "again"))), ("b", m(("assistant", "r"), ("user", None), (None, "x"))), ("c", []), ("d", None)],
        "id string, messages array<struct<role:string,content:string>>",
    ).filter("id <> 'a' or size(messages) = 6")
    assert [r["row"] for r in pairs.chat_pairs(df).collect()] == [None] * 3
    got = {(r["id"], r["turn"]): (r["question"], r["answer"]) for r in pairs.chat_pairs(df).collect()}
    assert got == {("a", 0): ("q1", "r1"), ("a", 4): ("q2", None), ("b", 1): (None, None)}


PAIRS = "dataset string, id string, row long, turn int, question string, answer string, context string"


def test_open_ends_are_settled_by_all_passages(spark):
    texts = spark.createDataFrame([("She saw the blue mirror. He saw the blue barrel in the hut.",), ("It was the blue vase, near the barrel.",), ("It was the blue vase, near the barrel.",), (None,), ("",)], "t string")
    ends = pairs.phrase_ends(texts, "t")
    got = {r["item"]: (r["n"], r["closed"]) for r in ends.collect()}
    assert got["blue"] == (3, 0) and got["barrel"] == (2, 2)
    ask = spark.createDataFrame(
        [
            ("d", "1", None, 0, "What?", "the blue", "x the blue mirror."),
            ("d", "2", None, 0, "What?", "the barrel", "x the barrel mirror."),
            ("d", "3", None, 0, None, None, None),
            ("d", "4", None, 0, "What?", "the green", "x the green mirror."),
        ],
        PAIRS,
    )
    found = {r["id"]: r["defects"] for r in pairs.defects(ask, ends).collect()}
    assert found == {"1": ["truncated"], "3": ["empty"]}
    assert pairs.defects(ask.limit(0), ends).count() == 0


def test_verdicts_do_not_move_with_the_number_of_passages(spark):
    ask = spark.createDataFrame([("d", str(i), None, 0, "What?", f"the {w}", f"x the {w} mirror.") for i, w in enumerate(("blue", "barrel", "odd"))], PAIRS)
    for k in (1, 10, 1000):
        ends = spark.createDataFrame([("blue", 20 * k, k), ("barrel", 20 * k, 19 * k), ("odd", 1, 0)], "item string, n long, closed long")
        assert {r["id"]: r["defects"] for r in pairs.defects(ask, ends).collect()} == {"0": ["truncated"], "2": ["truncated"]}


def test_rows_without_an_id_and_rows_delivered_again(spark):
    chats = spark.createDataFrame(
        [(i, [("user", q), ("assistant", a)]) for i, q, a in ((None, "How?", ""), (None, "How?", ""), (None, "Why?", ""), (None, "Why?", "Because it rains."), ("a", "How?", ""), ("a", "How?", ""))],
        "id string, messages array<struct<role:string,content:string>>",
    )
    ends = spark.createDataFrame([], "item string, n long, closed long")
    assert [tuple(r) for r in pairs.defects(pairs.chat_pairs(chats), ends).orderBy("id").collect()] == [("ultrachat_200k", None, 0, ["empty"])] * 2 + [("ultrachat_200k", "a", 0, ["empty"])]
    spoken = spark.createDataFrame([(None, None, None, None), (None, "q", None, None), ("b", "q", "", None), ("b", "q", "", None)], "id string, question string, answer_text string, context_text string")
    assert pairs.defects(pairs.question_pairs(spoken), ends).count() == 3


def test_empty_tables_and_clashing_names(spark):
    chats = spark.createDataFrame([("a", [("user", "How?"), ("assistant", "")], 7, 1, "x", "y")], "id string, messages array<struct<role:string,content:string>>, turn int, row int, kinds string, defects string")
    spoken = spark.createDataFrame([("b", "q", "", None, "x", 1)], "id string, question string, answer_text string, context_text string, answer string, item int")
    ends = pairs.phrase_ends(spoken, "context_text")
    both = pairs.question_pairs(spoken).unionByName(pairs.chat_pairs(chats))
    assert sorted(tuple(r) for r in pairs.defects(both, ends).collect()) == [("spoken_squad", "b", 0, ["empty"]), ("ultrachat_200k", "a", 0, ["empty"])]
    none = pairs.question_pairs(spoken.limit(0)).unionByName(pairs.chat_pairs(chats.limit(0)))
    assert pairs.defects(none, ends).count() == 0 and none.count() == 0


def test_very_long_replies():
    long = "It rains in the hut and so we wait. " * 20_000
    assert judge("Why do we wait?", long, None)[0] == []
    assert judge("Why do we wait?", long + "And the", None)[0] == ["truncated"]
