"""Sentences marked by hand, none of them made by the rule of the training table: [[...]] holds what is personal."""

import re

from heddle.llm import pii

MARKED = """
You can reach me on [[(212) 736-5000]] after six.
The office line is [[617.253.1000]] and the fax is broken.
Please call [[303-492-1411]] to confirm the booking.
From abroad dial [[0044 207 946 0958]] and ask for Mary.
Write to [[martha at greenfield dot org]] for the minutes.
Send the file to [[o.brien(at)harbour.co.uk]] before noon.
My address is [[jane_doe(at)corp.co.uk]], thanks.
mail [[press [at] lakeside.com]] with questions
It was paid with card [[4111.1111.1111.1111]] last week.
Visa [[4111-1111-1111-1111]] was declined.
The server at [[10 . 0 . 12 . 7]] did not answer.
The book has isbn 978 316 148 4100 on its back.
We shipped order 415 555 2671 items yesterday.
See ref 123-456-7890 invoice for the details.
The meeting is on 2024-11-05 at 10:30 in room 212.
Sales rose from 120,300.50 to 135,000.75 in 2023.
Version 2.14.3 of the library is out.
She ran 400 300 200 metres in a row.
The part no 555-0199 fits both models.
We met at noon and talked at length about the garden.
Look at barley. It grows fast.
Prices start at $199.99 and end at $249.
The score was 21-19, 18-21, 15-13.
Between 1914 and 1918 the mill stood still.
Serial 884-221-9034 is printed below.
Route 66 is 2448 miles long.
""".strip().split("\n")


def test_sentences_marked_by_hand():
    right, made, missed, false = 0, 0, [], []
    for line in MARKED:
        text, want = "", set()
        for i, part in enumerate(re.split(r"\[\[|\]\](?!\])", line.replace("[at]", "\0"))):
            part = part.replace("\0", "[at]")
            if i % 2:
                want.add((len(text), len(text) + len(part)))
            text += part
        base = pii.base_spans(text)
        got = {(a, b) for a, _, b in base + pii.field_spans([text], [base], pii.trained())[0]}
        right, made = right + len(want & got), made + len(want)
        missed += [text[a:b] for a, b in want - got]
        false += [text[a:b] for a, b in got - want]
    print("missed", missed, "false", false)
    assert right >= 0.8 * made and len(false) <= 2
