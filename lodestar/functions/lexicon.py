"""Stop words, synonyms, intent words and suffixes that results depend on."""

STOP_EN = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further "
    "had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own "
    "same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why with "
    "you your yours yourself yourselves"
).split()
STOP_ES = "de la que el en y a los del se las por un para con no una su al lo".split()
STOP_HI = "और का के की में है था थे तो से पर यह वह एक".split()
STOP = {"en": STOP_EN, "es": STOP_ES, "hi": STOP_HI}
#: The web profile's list lacks one word; its demo variant has it.
STOP_WEB = [w for w in STOP_EN if w != "can"]

SYNONYMS = {
    "en": {"bm25": ["ranking", "tfidf", "tf-idf"], "vector": ["embedding", "semantic"], "search": ["retrieve", "retrieval"]},
    "es": {"buscar": ["busqueda", "recuperar"], "vector": ["embebido", "semantico"]},
    "hi": {"खोज": ["सर्च", "खोजना"]},
}

SUFFIX_EN = "ing edly ed ly es s".split()
SUFFIX_ES = "mente aciones acion adoras adores ancia mente amiento amientos idades idad icos icas ico ica es os as s".split()

INTENTS = {
    "en": {"comparison": "vs versus compare difference better", "list": "list examples types top best", "factual": "what when where who why how define meaning"},
    "es": {"comparison": "vs versus comparar diferencia mejor", "list": "lista ejemplos tipos mejores", "factual": "que cuando donde quien por como"},
    "hi": {"comparison": "बनाम तुलना अंतर", "list": "सूची उदाहरण प्रकार", "factual": "क्या कब कहाँ कौन क्यों कैसे"},
}
#: Words that are no content when a short query is judged.
NO_CONTENT = "a an the of to in on for and or what who where when why how is are was were".split()
#: Words that are no subject of a question.
NO_SUBJECT = "what who when where why how define meaning is are was were the a an of to".split()

WEB_LIST = ["list", "top", "best", "types", "examples", "steps", "ways", "benefits", "pros", "cons"]
WEB_COMPARISON = ["compare", "vs", "versus", "difference", "differences", "better than", "compared to"]

NAMESPACES = "wikipedia category file template help portal draft user talk special".split()
VERB_CUES = [" is ", " are ", " was ", " were ", " refers to ", " means "]
DEFINITION_CUES = ["is a", "is an", "is the", "was a", "was an", "refers to", "means", "is a type of", "are a", "are the"]
DATE_KEYS = "date updatedAt createdAt publishedAt timestamp ingestedAt fetchedAt".split()
