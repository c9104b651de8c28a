"""Generation of annotated documents: every document depends on its own seed only, so partitions work alone."""

from __future__ import annotations

import bisect
import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.synth.template import Pad, Repeat, Section, Template, Text, Value

#: Exponent that flattens the weights of lists; chances of sections, of noise, and of a title other than the usual.
FLATTEN, SECTION_CHANCE, NOISE_CHANCE, RANK_CHANCE = 0.6, 0.7, 0.3, 0.1
Lists = dict[str, list[tuple[str, float]]]

# Small lists for a first corpus; larger ones are given as data.
DEFAULT_LISTS: Lists = {
    "first": [(w, 1.0) for w in "Claire Hugo Nora Simon Alice Bruno Emma Paul Rosa Jonas".split()],
    "last": [(w, 1.0) for w in "Martel Durieux Sandoval Keller Brunet Vasquez Lindner Morel Castelain Okafor".split()],
    "street": [(w, 1.0) for w in ("rue du Moulin", "avenue des Tilleuls", "chemin de la Source", "place du Marché", "impasse des Lilas")],
    "city": [(w, 1.0) for w in "Valmont Briançais Corvelles Montrevain Saint-Aubry".split()],
    "trade": [(w, 1.0) for w in ("Menuiserie", "Laboratoire", "Cabinet", "Clinique", "Atelier", "Transports")],
    "legal": [(w, 1.0) for w in "SARL SAS SA EURL".split()],
    "item": [(w, 1.0) for w in ("main-d'œuvre", "pose de cloison", "fourniture de joints", "forfait déplacement", "contrôle annuel")],
    "analysis": [(w, 1.0) for w in "Ferritine Hémogramme Glycémie Créatinine Cholestérol".split()],
}


# Written forms of persons with their weights.
PERSON_FORMS = {
    "civ_prenom_nom": 18, "civ_nom_prenom": 14, "prenom_nom": 16, "prenom_nom_caps": 12, "nom_prenom_caps": 14, "nom_seul": 6, "titre_nom": 6,
    "titre_nom_caps": 5, "nom_naissance": 4, "nom_prenom_etiquette": 3, "couple": 2,
}


def document_seed(seed: int, kind: str, lang: str, index: int) -> int:
    """A seed that depends on the document alone."""
    return int.from_bytes(hashlib.sha256(f"{seed}|{kind}|{lang}|{index}".encode()).digest()[:8], "big", signed=True)


class Picker:
    """Weighted choice with flattened weights, by binary search in their sums."""

    def __init__(self, rows: list[tuple[str, float]], flatten: float = FLATTEN):
        self.values = [v for v, _ in rows]
        self.sums, total = [], 0.0
        for _, w in rows:
            total += max(w, 0.0) ** flatten
            self.sums.append(total)

    def pick(self, rng: random.Random) -> str:
        return self.values[min(bisect.bisect_right(self.sums, rng.random() * self.sums[-1]), len(self.values) - 1)]


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if i % 2 == 0 else int(c) for i, c in enumerate(reversed(body)))
    return str(-total % 10)


def plain_ascii(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


class Writer:
    """Values of one document; equal slots show the same identity."""

    def __init__(self, lists: Lists, rng: random.Random):
        self.pick = {k: Picker(v) for k, v in lists.items() if v}
        self.rng = rng
        self.form = Picker(list(PERSON_FORMS.items()), 1.0)
        self.slots: dict[tuple[str, str], dict[str, str]] = {}

    def _of(self, name: str) -> str:
        return self.pick[name].pick(self.rng)

    def _slot(self, kind: str, slot: str) -> dict[str, str]:
        key = (kind, slot)
        if key not in self.slots:
            r = self.rng
            if kind == "PER":
                v = {"first": self._of("first"), "last": self._of("last"), "birth": self._of("last"), "title": r.choice(["M.", "Mme"]), "rank": r.choice(["Dr", "Pr", "Me"]) if r.random() < RANK_CHANCE else "Dr"}
            elif kind == "ORG":
                how = r.random()
                base = f"{self._of('trade')} {self._of('first')} {self._of('last')}" if how < 0.5 else f"{self._of('trade')} de {self._of('city')}" if how < 0.92 else self._of("trade")
                v = {"name": base, "legal": self._of("legal"), "capital": f"{r.randrange(1, 900)} 000"}
            else:
                v = {"number": str(r.randrange(1, 180)), "street": self._of("street"), "city": self._of("city"), "code": f"{r.randrange(1000, 99000):05d}"}
            self.slots[key] = v
        return self.slots[key]

    def person(self, v: Value) -> list[tuple[str, bool]]:
        """Pieces of a person's written form, each with whether it is a name: titles and labels stay outside the spans, a birth
        name and a labelled first name are spans of their own."""
        p = self._slot("PER", v.slot)
        first, last, caps, title = p["first"], p["last"], p["last"].upper(), p["title"] + " "
        doctor = p["rank"] + " "
        form = v.arg("form")
        if form not in PERSON_FORMS:
            form = self.form.pick(self.rng)
        if form == "couple":
            other = self._slot("PER", v.slot + "\0partner")
            return [(f"{last} {first}".upper(), True), (" ", False), (f"{other['last']} {other['first']}", True)]
        return {
            "civ_prenom_nom": [(title, False), (f"{first} {caps}", True)],
            "civ_nom_prenom": [(title, False), (f"{last} {first}", True)],
            "prenom_nom": [(f"{first} {last}", True)],
            "prenom_nom_caps": [(f"{first} {last}".upper(), True)],
            "nom_prenom_caps": [(f"{last} {first}".upper(), True)],
            "nom_seul": [(caps, True)],
            "titre_nom": [(doctor, False), (f"{caps} {first}", True)],
            "titre_nom_caps": [(doctor, False), (f"{last} {first}".upper(), True)],
            "nom_naissance": [(title, False), (f"{caps} {first}", True), (" (Née ", False), (p["birth"].upper(), True), (")", False)],
            "nom_prenom_etiquette": [(caps, True), (" Prénom : ", False), (first, True)],
        }[form]

    def organisation(self, v: Value) -> str:
        o = self._slot("ORG", v.slot)
        forms = {
            "court": "".join(w[0] for w in re.findall(r"\b[A-ZÀ-Þ]\w*", o["name"])), "caps": plain_ascii(o["name"]).upper(), "caps_tirets": plain_ascii(o["name"]).upper().replace(" ", "−"),
            "juridique_patronyme": f"{o['legal']} {o['name']}", "juridique_capital": f"{o['name']} – {o['legal']} au capital de {o['capital']} Euros",
        }
        return forms.get(v.arg("form"), o["name"])

    def address(self, v: Value) -> str:
        a = self._slot("ADDR", v.slot)
        street, city = f"{a['number']} {a['street']}", a["city"]
        forms = {
            "street": street, "citycode": f"{a['code']} {city}", "citycode_dash": f"{a['code']} − {city}", "citycedex": f"{a['code']} {city} Cedex", "city": city,
            "inline": f"{street} {a['code']} {city}", "inline_dash": f"{street} − {a['code']} {city}", "freeform": f"en face de {a['street']}",
        }
        form = v.arg("form", "inline")
        text = forms.get(form.removesuffix("_caps"), forms["inline"])
        return text.upper() if form.endswith("_caps") else text

    def value(self, v: Value) -> list[tuple[str, bool]]:
        r = self.rng
        n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
        if v.kind == "PER":
            return self.person(v)
        if v.kind == "ORG":
            return [(self.organisation(v), True)]
        if v.kind == "ADDR":
            return [(self.address(v), True)]
        if v.kind == "date":
            d, m, y = r.randrange(1, 29), r.randrange(1, 13), r.randrange(1950, 2026)
            months = "janvier février mars avril mai juin juillet août septembre octobre novembre décembre".split()
            forms = {"slash": f"{d:02d}/{m:02d}/{y}", "dash": f"{d:02d}-{m:02d}-{y}", "dotted": f"{d:02d}.{m:02d}.{y}", "iso": f"{y}-{m:02d}-{d:02d}", "long": f"{d} {months[m - 1]} {y}", "slash_time": f"{d:02d}/{m:02d}/{y} {r.randrange(24):02d}:{r.randrange(60):02d}", "long_time": f"{d} {months[m - 1]} {y} à {r.randrange(24)}h{r.randrange(60):02d}"}
            return [(forms.get(v.arg("format"), forms["slash"]), False)]
        if v.kind == "amount":
            return [(f"{r.randrange(1, 900)},{n(2)}" + ("" if v.arg("form") == "medical" else " €"), False)]
        if v.kind == "ref":
            return [((v.arg("pattern") or "R") + n(7), False)]
        if v.kind in ("siren", "siret"):
            body = r.choice("123456789") + n(7)
            siren = body + luhn_digit(body)
            branch = siren + n(4)
            return [(siren if v.kind == "siren" else branch + luhn_digit(branch), False)]
        if v.kind == "iban":
            account = n(23)
            return [(f"FR{98 - int(account + '152700') % 97:02d}{account}", False)]
        if v.kind == "email":
            p = self._slot("PER", v.arg("from")) if ("PER", v.arg("from")) in self.slots else {"first": "contact", "last": self._of("last")}
            mail = plain_ascii(f"{p['first']}.{p['last']}").lower().replace(" ", "") + "@exemple.test"
            return [(mail.upper() if r.random() < 0.15 else mail, False)]
        if v.kind == "phone":
            digits = "0" + r.choice("1234567") + n(8)
            pairs = [digits[i : i + 2] for i in range(0, 10, 2)]
            return [({"dotted": ".".join(pairs), "intl": "+33 " + digits[1] + " " + " ".join(pairs[1:])}.get(v.arg("form"), " ".join(pairs)), False)]
        return [(self.decoy(v.slot), False)]

    def decoy(self, kind: str) -> str:
        r = self.rng
        n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
        if kind == "ref_longue":
            body = n(13)
            return body + str((int(luhn_digit(body)) + 1) % 10)
        return {
            "voie_nom": lambda: f"avenue {self._of('first')} {self._of('last')}", "orgperson": lambda: f"{self._of('legal')} {self._of('trade')} {self._of('first')} {self._of('last')}", "id_secteur": lambda: n(9),
            "titre_caps": lambda: self._of("analysis").upper(), "mention": lambda: f"Article {r.randrange(1, 300)} du code, décret {r.randrange(1950, 2020)}-{n(3)}", "designation": lambda: self._of("item"),
            "analyse": lambda: self._of("analysis"), "code_court": lambda: f"{n(4)}{r.choice('ABCDEZ')}", "domaine": lambda: plain_ascii(self._of("trade")).lower(), "age": lambda: f"{r.randrange(1, 99)} ans",
        }.get(kind, lambda: self._of("item"))()


Piece = tuple[str, str, str, str]  # text, label, slot, form


def render(template: Template, lists: Lists, seed: int) -> tuple[str, list[dict], list[str], bool]:
    """(text, spans, sections taken, noised) of one document."""
    rng = random.Random(seed)
    writer = Writer(lists, rng)
    taken: dict[str, bool] = {}
    noised = rng.random() < NOISE_CHANCE

    def walk(nodes: tuple, noise: bool) -> Iterator[Piece]:
        for node in nodes:
            if isinstance(node, Text):
                text = node.text
                if noise and noised:
                    text = re.sub(r"(?<=\w\w)(?=\w\w)", lambda _: " " if rng.random() < 0.08 else "", text)
                yield text, "", "", ""
            elif isinstance(node, Pad):
                yield " " * rng.randint(node.least, node.most), "", "", ""
            elif isinstance(node, Repeat):
                lines = template.blocks[node.block]
                for _ in range(rng.randint(node.least, node.most)):
                    yield from walk(lines[rng.randrange(len(lines))], noise)
                    yield "\n", "", "", ""
            elif isinstance(node, Section):
                if node.noise:
                    yield from walk(node.body, True)
                elif taken.setdefault(node.name, rng.random() < SECTION_CHANCE):
                    yield from walk(node.body, noise)
            else:
                for text, annotated in writer.value(node):
                    stripped = text.rstrip()
                    yield stripped, node.label if annotated else "", node.slot, node.arg("form")
                    if stripped != text:
                        yield text[len(stripped) :], "", "", ""

    out, spans, at = [], [], 0
    for text, label, slot, form in walk(template.body, False):
        if label and text:
            spans.append({"text": text, "label": label, "start_off": at, "end_off": at + len(text), "slot": slot, "form": form or None})
        out.append(text)
        at += len(text)
    return "".join(out), spans, sorted(k for k, v in taken.items() if v), noised


SPAN = T.StructType([T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("start_off", T.IntegerType()), T.StructField("end_off", T.IntegerType()), T.StructField("slot", T.StringType()), T.StructField("form", T.StringType())])
DOCUMENT = T.StructType([
    T.StructField("doc_index", T.LongType()), T.StructField("template", T.StringType()), T.StructField("doc_type", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("seed", T.LongType()),
    T.StructField("noised", T.BooleanType()), T.StructField("sections", T.ArrayType(T.StringType())), T.StructField("text", T.StringType()), T.StructField("entities", T.ArrayType(SPAN)),
])


def corpus(spark: SparkSession, templates: list[Template], n: int, seed: int = 0, lists: Lists | None = None, partitions: int | None = None) -> DataFrame:
    """n documents: the template of each is drawn by weight from its own seed."""
    lists = lists or DEFAULT_LISTS
    order = Picker([(str(i), t.weight) for i, t in enumerate(templates)])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i in batch["id"]:
                s = document_seed(seed, "document", "", int(i))
                t = templates[int(order.pick(random.Random(s)))]
                own = document_seed(seed, t.head.get("type", ""), t.head.get("lang", ""), int(i))
                text, spans, sections, noised = render(t, lists, own)
                rows.append((int(i), t.name, t.head.get("type"), t.head.get("lang"), t.head.get("source"), own, noised, sections, text, spans))
            yield pd.DataFrame(rows, columns=DOCUMENT.names)

    return spark.range(0, n, 1, partitions or spark.sparkContext.defaultParallelism).mapInPandas(make, DOCUMENT)


def manifest(docs: DataFrame, generator: str, batch: int = 0) -> DataFrame:
    """One row about a corpus: documents, spans by label."""
    labels = docs.select(F.explode("entities").alias("e")).groupBy(F.col("e.label").alias("label")).agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    return docs.agg(F.count(F.lit(1)).alias("doc_count")).join(F.broadcast(labels)).select(F.lit(batch).alias("batch_no"), F.lit(generator).alias("generator"), "doc_count", "label_counts")
