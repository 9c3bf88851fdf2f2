"""Precision and recall of names and streets on sentences that share no frame, name or road with the labelled table."""

from __future__ import annotations

from corpusloom.llm import pii

FIRST = "Martin Helen George Sarah Diego Carmen Oliver Emma Ravi Priya Hugo Nina Felix Irene Samuel Ruth Jorge Lucia Stefan Greta".split()
LAST = "Walker Meyer Schulz Fischer Garcia Moreno Dupont Laurent Kumar Sharma Nielsen Hansen Wright Cooper Bailey Romano Weber Costa Ivanov Yamada".split()
ROADS = "Maple Garden Bridge Forest Castle Victoria Spring Queen Meadow Harbour".split()
KINDS = "Street Road Avenue Lane Drive".split()
NAMES = (
    "For details ask {f} {l} in the sales team.", "The parcel was sent to {f} {l} on Tuesday.", "Dear {t} {l}, your order is ready.", "Yesterday {t} {f} {l} called the office again.",
    "Our new manager is {t} {f} {l} from the north.", "signed by {f} {l} in June", "It was {t} {l} who wrote the first letter.", "Contact {f} {l} for a quote.", "The patient {f} {l} was seen at ten.",
    "My name is {f} {l}, I am writing about the bill.", "Customer: {f} {l}", "We thank {t} {f} {l} for the help.", "the author {f} {l} lives near the sea", "Kind regards, {f} {l}", "Please call {t} {l} before noon.",
)
STREETS = (
    "Our shop is located at {n} {r} {k} in the old town.", "He lives at {n} {r} {k} with two dogs.", "Deliver the box to {n} {r} {k}, please.", "The new address is {n} {r} {k}.", "They moved to {n} {r} {k} in spring.",
)
BOTH = ("Contact: {f} {l}, {n} {r} {k}", "{t} {f} {l} lives at {n} {r} {k}.")
NONE = (
    "The committee met on Friday and agreed on the plan.", "There were 25 chairs and 3 tables in the hall.", "In 2015 the company opened a second plant.", "A long road leads to the lake in the north.",
    "Read Chapter 7 of the Manual before you begin.", "The Museum of Modern Art is closed on Mondays.", "Prices rose by 4 percent in March and fell in April.", "please contact the help desk for support",
    "Der Zug nach Hamburg fährt um 9 Uhr ab.", "Le chat dort sur la table de la cuisine.", "El perro duerme en la casa azul.", "Terms and Conditions apply to all Orders.", "He walked along the street and said nothing.",
    "Error 404: the page was not found.", "Windows and Linux are supported since Version 3.", "Name, Email and Phone are required fields.", "Step 12: press the red button twice.", "The United Nations published a report.",
    "Rain fell. Wind blew. The boats stayed in the harbour.", "All my friends like green tea and honey.",
)
TITLES = "Mr. Mrs. Dr. Ms. Prof.".split()


def sentences():
    i = 0
    for frames, turns in ((NAMES, 12), (STREETS, 10), (BOTH, 10), (NONE, 2)):
        for frame in frames:
            for _ in range(turns):
                i += 1
                of = {"t": TITLES[i % 5], "f": FIRST[i * 7 % 20], "l": LAST[i * 3 % 20], "n": str(i * 31 % 400 + 1), "r": ROADS[i % 10], "k": KINDS[i * 3 % 5]}
                name = " ".join(of[x] for x in "tfl" if f"{{{x}}}" in frame)
                street = f"{of['n']} {of['r']} {of['k']}"
                yield frame.format(**of), ([("name", name)] if "{l}" in frame else []) + ([("street", street)] if "{r}" in frame else [])


def test_precision_and_recall(spark):
    rows = list(sentences())
    assert len(rows) >= 200 and not {x for s, _ in rows for x in s.split()} & {*pii.FIRST, *pii.LAST}
    docs = spark.createDataFrame([(i, s) for i, (s, _) in enumerate(rows)], "doc_id long, text string")
    right = said = there = 0
    for r in pii.scan_pii(docs, found_column=True).collect():
        text, want = rows[r["doc_id"]]
        got = {(f["kind"], text[f["start"] : f["end"]]) for f in r["found"] if f["kind"] in ("name", "street")}
        right, said, there = right + len(got & set(want)), said + len(got), there + len(want)
    print(f"precision {right / said:.3f}, recall {right / there:.3f} of {there} spans")
    assert right / said >= 0.9 and right / there >= 0.9
