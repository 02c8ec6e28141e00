import random


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))
