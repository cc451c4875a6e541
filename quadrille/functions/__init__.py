"""Terms and the scalar functions over them."""
