"""What the registered queries ask for."""

QUERY = "rend onwh éléau and the tion der 369"
REPEATED = "tion tion tion onwh"
STOPWORD_QUERY = "a de da que e the"
LABEL = 3
QUERY_VECTOR = [((i * 7) % 13 - 6) / 10 for i in range(64)]
MODEL_NAMES = [
    "BAAI/bge-m3",
    "infly/inf-retriever-v1-5b",
    "someone/STELLA-large",
    "text-embedding-3-small",
    "me/unknown-model",
    "x/multilingual-e5-base",
]
