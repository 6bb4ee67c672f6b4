"""Lines that the field of personal data never sees in training: other sentences, names, numbers and places, all made up."""

import random

NAMES = ["Olivia Hunt", "Marcus Webb", "Priya Sharma", "Lukas Brandt", "Chloe Martin", "Diego Navarro", "Hannah Cole", "Tobias Wolf", "Yuki Tanaka", "Edward P. Flynn", "Beatrice Moran", "Samuel O'Connor", "Marie-Claire Roux", "K. L. Simmons", "Nadia Haddad"]
PHONES = ["(404) 555-0102", "(510) 555-0177", "702-555-0139", "555-0164", "0131 496 0211", "030 2345678", "01 55 00 43 21", "303.555.0108"]
MAILS = ["lena(at)example.com", "r.patel[at]example.org", "kim [at] example [dot] net", "omar(at)example.fr", "post@localhost"]
IPS = ["2001:db8:7::9", "fe80::abcd:12ff:fe00:1", "2001:db8::8a2e:370:7335"]
CARDS = ["4111.1111.1111.1111", "5105/1051/0510/5100", "4222.2222.2222.22220", "6011.1111.1111.1117"]
IDS = ["321-54-9876", "601-22-4455", "K7PL22QX9", "DE02120300000000202051", "GB33 BUKB 2020 1555 5555 55", "NL91ABNA0417164300"]
STREETS = ["78 Willow Road", "1201 Birch Avenue, Portland, OR 97205", "6 Station Lane", "33 North Ridge Drive", "19 Queen's Court, Bath", "250 Harbor Boulevard"]
GERMAN, FRENCH, SPANISH = ["Schillerstraße 41, 04109 Leipzig", "Rosenweg 12"], ["8 rue des Lilas, 31000 Toulouse", "52 avenue Foch"], ["Calle Real 19, 41001 Sevilla", "Avenida Central 5"]

TEMPLATES = {
    "NAME": (NAMES, ["My name is {}.", "Dear {}, thanks for your note", "Mr. {} was not at home", "we saw Dr. {} on Tuesday", "Best regards, {}", "Contact {} about the keys", "the patient {} came back", "name: {}", "report written by {} last year",
        "I met {} at the station", "her husband {} is away", "customer {} has paid", "Signed, {}"]),
    "PHONE": (PHONES, ["call {} after lunch", "my phone is {} at work", "Tel.: {}", "Phone: {}", "you can reach them at {} today", "fax {} is broken", "the number {} rang", "mobile {} or the desk"]),
    "EMAIL": (MAILS, ["write to {} about it", "email: {}", "contact {} for details", "mail {} please", "my address is {} now"]),
    "IP": (IPS, ["the host {} is slow", "login from {} was refused", "server {} came up", "address {} in the log"]),
    "CARD": (CARDS, ["my card {} was lost", "card number: {}", "paid with visa {} today", "card {} expires soon"]),
    "ID": (IDS, ["ssn {} is on the form", "passport number {} was read out", "iban: {}", "Passport No. {} is valid", "his iban {} is known"]),
    "ADDRESS": (STREETS, ["she lives at {} with a cat", "address: {}", "ship to {} by Friday", "deliver to {} please", "moved to {} in spring", "the house at {} was sold"]),
    "ADDRESS ": (GERMAN, ["wohnt in der {} mit Hund", "Adresse: {}", "Anschrift {} im Hof"]),
    "ADDRESS  ": (FRENCH, ["habite {} depuis mai", "adresse : {}"]),
    "ADDRESS   ": (SPANISH, ["vive en {} con su gato", "dirección: {}"]),
}

PLAIN = """
The river was high. Nobody crossed it that day.
Version 4.2 of the tool was out in 2018
see table 7 and section 9.3 for more
on 2023-11-30 at 08:15 the train left
about 3,400,000 trees in 12 parks
Licensed under the Mozilla Public License, Version 1.1
In August the Royal Society met in Vienna.
Blue Blue and Red Red again
the ratio was 3:1 and the time 11:20:05
order 7712093 has 4 items at 12.50 each
This chapter is short. The next one is not.
isbn 978-0-596-52068-7 is out of print
commit 9e8d7c6 closed issue 412
Wir gehen heute. Am Abend kommt Regen. Das ist alles.
La ville dort. Le port est calme. Tout est bien.
La mesa es nueva. El libro no. Todo sigue igual.
Redistributions must keep the above notice
NO WARRANTY OF ANY KIND IS GIVEN
Sales rose 12% in March and 9% in April
call 2 friends and mail 30 others
a 9182736450192837 counter was reset
the Black Sea and the North Pole are far apart
Ask the Manager. Tell the Story. End the Day.
room 12 on floor 4 of building 9
It rained. We stayed. They left at 5.
10 20 30 40 50 are the steps
sha 0a4d55a8d778e5022fab701977c5d840bbc486d0 was built
Street names and house numbers are on the map
Customer service and Customer care are closed
Copyright 1999 2003 2011 by the authors
""".strip().split("\n")


def held_out(n: int = 240, seed: int = 4) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Lines with their entities (kind, start, end): every sentence with some of its fillers, and lines without any."""
    rng = random.Random(seed)
    out = [(line, []) for line in PLAIN]
    sentences = [(k.strip(), values, s) for k, (values, many) in TEMPLATES.items() for s in many]
    while len(out) < n:
        kind, values, sentence = sentences[len(out) % len(sentences)]
        value = rng.choice(values)
        at = sentence.index("{}")
        out.append((sentence.format(value), [(kind, at, at + len(value))]))
    return out
