"""Colour words of several languages and the colour they mean."""

# By English name, the words other languages use, folded (no accents, lower case).
COLOURS = {
    "white": "white bijela bela bijeli weiss blanc bianco",
    "black": "black crna crni schwarz noir nero",
    "grey": "grey gray siva sivi grau gris grigio",
    "blue": "blue plava plavi modra blau bleu blu",
    "navy": "navy teget dunkelblau marine",
    "red": "red crvena crveni rdeca rot rouge rosso",
    "green": "green zelena zeleni grun vert verde",
    "yellow": "yellow zuta zuti rumena gelb jaune giallo",
    "brown": "brown smeda smedi rjava braun marron marrone",
    "beige": "beige bez",
    "pink": "pink roze roza rosa rose",
    "purple": "purple ljubicasta ljubicasti vijolicna lila violet viola",
    "orange": "orange narandzasta narandzasti narancasta oranzna arancione",
    "silver": "silver srebrna srebrni silber argent argento",
    "gold": "gold zlatna zlatni dore oro",
    "burgundy": "burgundy bordo bordeaux",
    "turquoise": "turquoise tirkizna tirkizni turkizna turkis turquesa turchese",
}
#: word -> colour
COLOUR_OF = {w: c for c, ws in COLOURS.items() for w in ws.split()}
# Words for the kind of goods, which tell listings of shoes nothing.
CATEGORY_WORDS = "patike patika tenisice tenisica obuca sneaker sneakers shoes shoe cipele cipela superge copati schuhe schuh scarpe chaussures".split()
