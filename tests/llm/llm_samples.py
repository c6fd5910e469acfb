"""Made-up prose."""

WORDS = "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", "s", "ing", "ed", ","]) + (str(rng.randrange(100)) if rng.random() < 0.1 else "") for _ in range(n))


def mutate(rng, text, share):
    return " ".join(w if rng.random() > share else w + "x" for w in text.split(" "))
