import random


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join("".join(draw.choices("aeinorst", k=draw.randrange(2, 8))) for _ in range(words))
