from oracles import description, evaluation, preparation, text

ORACLES = {**preparation.ORACLES, **description.ORACLES, **evaluation.ORACLES, **text.ORACLES}
