"""Good statements printed over two pages, cut at every line below the header, give the one-page ledger."""

import pytest

from ledgerloom.operators.outcome import parse_and_check
from tests import texts as X

TEXTS = {"checking": X.CHECKING, "savings": X.SAVINGS, "card": X.CARD, "brokerage": X.BROKERAGE,
         "fund": X.FUND, "combined": X.COMBINED,
         "combined-split": X.COMBINED.replace("Starting Balance: $", "Starting Balance:\n$"),
         "brokerage-split": X.BROKERAGE.replace("Holdings Total: $", "Holdings Total:\n$")}


def header_lines(name):
    lines = TEXTS[name].split("\n")
    marks = ("period", "account number", "account type", "account ending", "registration", "*")
    return max(k for k, line in enumerate(lines[:12]) if any(m in line.lower() for m in marks)) + 1


def documents():
    """(doc_id, page_number, page_text): cut places, a blank page between, other first numbers."""
    rows = []
    for name, text in TEXTS.items():
        lines = text.split("\n")
        rows.append((f"{name}|whole", 1, text))
        for cut in range(header_lines(name), len(lines)):
            parts = ["\n".join(lines[:cut]), "\n".join(lines[cut:])]
            rows += [(f"{name}|{cut}", 1, parts[0]), (f"{name}|{cut}", 2, parts[1])]
            first = (0, 2, 7)[cut % 3]
            rows += [(f"{name}|{cut}b", first, parts[0]), (f"{name}|{cut}b", first + 1, " \n\t"),
                     (f"{name}|{cut}b", first + 5, parts[1])]
    return rows


@pytest.fixture(scope="module")
def parsed(spark):
    pages = spark.createDataFrame(documents(), "doc_id string, page_number int, page_text string")
    ledger, runs, failures = parse_and_check(pages)
    statements = ledger.statements.collect()
    run_of = {s.statement_id: s.run_id for s in statements}
    content = {}
    for s in statements:
        content.setdefault(s.run_id, []).append(("s", *tuple(s)[5:]))
    for t in ledger.transactions.collect():
        content[run_of[t.statement_id]].append(("t", *tuple(t)[2:]))
    for h in ledger.holdings.collect():
        content[run_of[h.statement_id]].append(("h", *tuple(h)[2:]))
    return {r.run_id: r for r in runs.collect()}, failures.collect(), {
        k: sorted(map(str, v)) for k, v in content.items()}


def test_every_break_gives_the_one_page_result(parsed):
    runs, failures, content = parsed
    wanted = {doc for doc, *_ in documents()}
    assert set(runs) == wanted
    broken = {f.doc_id.split("|")[0] for f in failures}
    assert broken <= {"brokerage-split"}  # the total's amount must stand on its line
    for doc in wanted:
        whole = doc.split("|")[0] + "|whole"
        assert (runs[doc].status, runs[doc].error_code) == (runs[whole].status, runs[whole].error_code), doc
        assert content.get(doc) == content.get(whole), doc
