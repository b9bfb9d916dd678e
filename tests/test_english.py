import pytest
from pyspark.sql import functions as F

from murmurate.functions import english

CASES = {
    "clocks": [("06:30", "630"), ("six thirty", "630"), ("11:35", "1135"), ("eleven thirty five", "1135"), ("12:00", "12"), ("10:00-11:00 p.m.", "10 to 11 pm"), ("ten to eleven p m", "10 to 11 pm"), ("from 6:00 - 07:15", "from 6 to 715"), ("25:30", "25 30"), ("25:00", "25 00")],
    "initials": [("U.S. CIA p.m.", "us cia pm"), ("US C.I.A. pm", "us cia pm"), ("the u s team", "the us team")],
    "contractions": [("Hello, World! don't stop", "hello world do not stop"), ("We won't go to the centre", "we will not go to the center"), ("don’t", "do not"), ("it's been", "it has been"), ("I'd gone, he's got, she'd run", "i had gone he has got she would run"), ("y'all gonna", "you all going to"), ("they 're", "they are")],
    "titles": [("Mr. Smith and Dr. No", "mister smith and doctor no")],
    "fillers and asides": [("uh, half [noise] (x) of <b> it hmm", "half of it")],
    "years and per cent": [("By 1976, thirty percent", "by 1976 30%"), ("By 1976, 30 percent", "by 1976 30%"), ("nineteen seventy-six, thirty percent", "1976 30%"), ("nineteen seventy six thirty percent", "1976 30%"), ("nineteen hundred, thirty percent", "1900 30%"), ("nineteen oh five ten percent", "1905 10%"), ("nineteen seventy six one hundred percent", "1976 100%"), ("twenty five percent", "25%"), ("ten per cent", "10%")],
    "numbers": [("one hundred and five", "105"), ("two thousand twenty", "2020"), ("twenty twenty", "2020"), ("one two three", "123"), ("three hundred million", "300000000"), ("one million two hundred thousand", "1200000"), ("hundreds of", "100s of"), ("double oh seven", "007"), ("10 thirty", "1030"), ("5 hundred", "500"), ("1,234.5", "1234.5"), ("one hundred one hundred", "100 100"), ("minus five", "-5"), ("1500 five", "1500 5")],
    "decimals": [("three point one four", "3.14"), ("two and a half million dollars", "$2500000"), ("zero point five", "0.5")],
    "ordinals and plurals": [("the twenty first of May", "the 21st of may"), ("nineteen eighties", "1980s"), ("third, 3rd and twelfth", "3rd 3rd and 12th"), ("two hundredth", "200th"), ("one thousandth", "1000th")],
    "money": [("I have 100 dollars and 5 cats", "i have $100 and 5 cats"), ("$2.5 million", "$2500000"), ("five dollars and seven cents", "$5.07"), ("ten euros, two pounds", "€10 £2"), ("fifty cents", "¢50")],
    "one": [("one", "one"), ("1 cat", "one cat"), ("the ones", "the ones")],
    "spelling": [("colour's analysed, realised", "color is analyzed realized"), ("the travellers' theatre dialogue", "the travelers theater dialog"), ("surprise promise wise raised advertised", "surprise promise wise raised advertised"), ("grey defence", "gray defense")],
    "letters": [("naïve café Straße", "naive cafe strasse"), ("THE CAT-SAT", "the cat sat"), ("rock'n'roll a/b", "rock n roll ab")],
    "nothing": [("", ""), (None, None), ("...", ""), ("$ % .", "")],
}


@pytest.mark.parametrize("text,want", [c for cases in CASES.values() for c in cases])
def test_english(text, want):
    assert english.english(text) == want


@pytest.mark.parametrize("n", [2, 15, 20, 21, 99, 100, 105, 200, 219, 999, 1000, 1001, 1900, 2020, 12345, 100000, 1000000, 2345678, 10**9 + 7])
def test_numbers_read_back(n):
    """Every number that is spelled out is read as itself."""

    def spell(n):
        units, tens = list(english.UNITS), list(english.TENS)
        for scale, exp in reversed(english.SCALES.items()):
            if n >= 10**exp:
                return f"{spell(n // 10**exp)} {scale}" + (f" {spell(n % 10**exp)}" if n % 10**exp else "")
        if n >= 100:
            return f"{units[n // 100]} hundred" + (f" and {spell(n % 100)}" if n % 100 else "")
        return units[n] if n < 20 else tens[n // 10 - 2] + (f" {units[n % 10]}" if n % 10 else "")

    assert english.english(spell(n)) == str(n)


def test_again_and_in_spark(spark):
    """A normal form is its own normal form, and whole columns go through the same function."""
    rows = [t for cases in CASES.values() for t, _ in cases if t]
    got = spark.createDataFrame([(t,) for t in [*rows, None]], "t string").select("t", english.english_text(F.col("t")).alias("n")).collect()
    assert all(r["n"] == english.english(r["t"]) for r in got)
    steady = [english.english(t) for t in rows if "point" not in t and "$" not in t and "half" not in t]
    assert sum(english.english(t) != t for t in steady) <= len(steady) // 10
    long = "It's twenty five dollars, colour me surprised. " * 20000
    assert english.english(long).count("$25") == 20000
