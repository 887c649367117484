def sentence(rng, n, words=400):
    """n random words of a vocabulary of the given size."""
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))
